"""Personal data by weak supervision, on DataFrame functions alone (operator 6).

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Candidates for more are the spans of wider
patterns (`WIDER`): local numbers, identity and account numbers, spelled-out addresses, handles, streets, and names whose
first word is in the gazetteer. Three labelers vote on each candidate (1 personal, 2 not) or abstain (0): a regex labeler
on its form, a gazetteer labeler on given names and places in and before it and on values known to be nobody's, and a
context labeler on the words before it. The votes are counted by pattern; expectation-maximisation over the counts
estimates how often each labeler is right on personal spans and on others, and each kind's share, as aggregates of a
small table with one row of results a round, until they settle. The posteriors then train the final span classifier, a
naive Bayes over features that no labeler reads: the kind, the length, the share of digits, the neighbours and a hash of
the word before. A candidate that it accepts and that overlaps no base span is added.

Positions are code points, ends exclusive. A pattern's matches are marked in one pass and the text is split at the marks;
running sums of the pieces' lengths are the positions. Running values go by blocks, so a text of n matches takes about
n ** 1.5 small steps and never a join. The patterns are the contract's, written so that Java's engine neither backtracks
nor recurses over long runs.

Defined results: null texts are empty; empty tables give empty ones; repeated rows give repeated rows; a table without
candidates adds nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, text_or_empty

BASE = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The gazetteer: common given names and places, and values that belong to nobody.
NAMES = "Adam Alain Alan Alexander Alice Ana Andrea Andreas Andrew Angela Anna Anne Antonio Barbara Benjamin Bernard Brian Bruno Camille Carla Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine Claire Clara Claudia Daniel David Diego Dominique Edward Elena Elizabeth Emily Emma Eric Eva Fatima Felix Francisco Frank Gabriel George Hannah Hans Helen Helga Henri Henry Ingrid Isabel Ivan Jacques James Jan Javier Jean Jennifer Jessica Joan John Jorge Joseph Juan Julia Julie Karen Karl Kevin Klaus Laura Laurent Linda Lisa Louis Lucas Lucia Luis Manuel Marc Maria Marie Mark Martin Mary Matthew Michael Michel Miguel Mohammed Monika Nathalie Nicolas Nina Olivia Pablo Patricia Patrick Paul Pedro Peter Philippe Pierre Rachel Rafael Ralf Rebecca Richard Robert Rosa Sabine Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Susan Sylvie Teresa Thomas Tobias Ursula Valerie Victor Walter William Wolfgang Yves".split()
PLACES = "Amsterdam Barcelona Berlin Birmingham Bordeaux Boston Brussels Chicago Cologne Dallas Dublin Edinburgh Frankfurt Geneva Hamburg Lille Lisbon London Lyon Madrid Manchester Marseille Miami Milan Montreal Munich Nantes Paris Porto Rome Seattle Sevilla Stuttgart Sydney Toronto Toulouse Valencia Vienna Zurich".split()
NOBODY = r"(?i)(no-?reply|example\.|localhost|webmaster|postmaster|@(media|import|param|return|override|deprecated|property|see|since|author)$|^@?(everyone|channel|here|all)$|555-?01[0-9]{2}$|123-45-6789|000-00-0000)"
KNOWN = rf"\b({'|'.join(NAMES + PLACES)})\b"
#: Wider candidates: local phone numbers, social security numbers, account numbers, spelled-out addresses, handles, streets, names.
WIDER = {
    "local": r"(?<![0-9+().-])(?<![0-9+(][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[\[({]at[\])}][\x20]?[A-Za-z0-9-]{1,64}[\x20]?(?:\.|[\[({]dot[\])}])[\x20]?[A-Za-z]{2,12}",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@.])",
    "street": r"(?<![A-Za-z0-9])[0-9]{1,5}[\x20][A-Z][a-z]{1,30}[\x20](?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)(?![A-Za-z])",
    "name": rf"(?<![A-Za-z])(?=[A-Z])(?:{'|'.join(NAMES)})[\x20][A-Z][a-z]{{1,30}}(?![A-Za-z])",
}
KINDS = (*BASE, *WIDER)
#: What a text must hold for a pattern to be tried at all.
GUARDS = {"email": "@", "ip": ".", "phone": "+", "spelled": "at", "handle": "@", "ssn": "-"}
CUES = r"(?i)\b(e-?mail|mail|contact|phone|tel|telephone|telefon|tél|teléfono|call|fax|mobile|card|visa|credit|ssn|social security|iban|account|konto|cuenta|compte|ip|address|adresse|reach|write to|name|mr|mrs|dear|lives at|regards)\b[^\n]{0,16}$"
AGAINST = r"(?i)\b(version|ver|isbn|issn|order|invoice|ticket|page|section|figure|doi|build|serial|model|part)\b[^\n]{0,8}$"
#: What a kind's spans look like, and what they don't; the regex labeler abstains on the others.
FORMS = {
    "local": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "spelled": r"(?i)(com|org|net|edu|de|fr|es)$", "handle": r"_|[0-9]$", "street": r"(Street|Avenue|Road|Lane|Boulevard)$", "name": r"^[A-Z][a-z]+ [A-Z][a-z]{2,}$",
}
MISFITS = {
    "local": r"^\(?[01]|^\(?[0-9]{3}\)?[ .-][01]", "ssn": r"^(000|666|9)|-00-|-0000$", "iban": r"^[A-Z]{2}[0-9]+$|^[A-Z]{3}", "spelled": r"(?i)[0-9]$|^at",
    "handle": r"(?i)^@[a-z]{1,3}$", "street": r"^0", "name": r"(Street|Avenue|Road|University|College|Day)$",
}
LABELERS = ("form", "gazetteer", "context")
#: The classifier's features, with the number of their values.
FEATURES = {"k": len(KINDS), "size": 6, "digits": 4, "left": 4, "right": 4, "word": 32}
MARK, OTHER = "\u0001", "\u0002"


def running(values: Column, start: int, step) -> Column:
    """The values of a fold after each element, block by block: only a block's values are copied at each of its steps."""
    n = F.size(values)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * width + 1, width))
    last = lambda a: F.element_at(a, -1)
    inner = lambda acc, block: F.aggregate(block, F.array(last(acc)), lambda a, x: F.concat(a, F.array(step(last(a), x))))
    every = F.aggregate(blocks, F.array(F.lit(start)), lambda acc, block: F.concat(acc, F.slice(inner(acc, block), F.lit(2), F.size(block))))
    return F.slice(every, F.lit(2), n)


def partial_of(f, *given):
    """f with its first arguments given, as a function of one column."""
    return lambda s: f(*given, s)


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(raw: Column) -> Column:
    """Digits from the right; each second one doubles."""
    d = F.reverse(digits(raw))

    def term(i):
        x = F.substr(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, raw: Column) -> Column | None:
    if kind == "ip":
        parts = F.transform(F.split(raw, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(raw)
    if kind == "phone":
        return F.length(digits(raw)).between(9, 15)
    return None


def pieces(clean: Column, kind: str) -> Column:
    """The text before, in and after each match in turn; null without a match. clean: a text without MARK."""
    cut = F.split(F.regexp_replace(clean, F.lit((PATTERNS | WIDER)[kind]), F.lit(f"{MARK}$0{MARK}")), MARK)
    return F.when(F.contains(clean, F.lit(GUARDS[kind])), cut).otherwise(F.lit(None)) if kind in GUARDS else cut


def spans_of(k: int, kind: str) -> Column:
    """array<struct> of the matches whose pieces are in p{k} and whose pieces' ends are in e{k}."""
    p, e = F.col(f"p{k}"), F.col(f"e{k}")

    def span(i):
        raw = F.get(p, 2 * i + 1)
        one = [F.get(e, 2 * i).alias("at"), F.lit(k).alias("k"), F.get(e, 2 * i + 1).alias("end")]
        if kind in BASE:
            return F.struct(*one, raw.alias("raw"))
        gap = F.concat(F.coalesce(F.get(p, 2 * i - 1), F.lit("")), F.get(p, 2 * i))
        return F.struct(*one, *votes_and_features(kind, raw, F.right(gap, F.lit(32)), F.substring(F.get(p, 2 * i + 2), 1, 1)))

    found = F.transform(F.sequence(F.lit(0), ((F.size(p) - 3) / 2).cast("int")), span)
    if kind in BASE:
        kept = F.filter(found, lambda s: valid(kind, s["raw"])) if kind != "email" else found
        return F.transform(kept, lambda s: F.struct(s["at"].alias("at"), s["k"].alias("k"), s["end"].alias("end")))
    return found


def votes_and_features(kind: str, raw: Column, before: Column, after: Column) -> list[Column]:
    vote = lambda yes, no: F.when(no, 2).when(yes, 1).otherwise(0)
    side = lambda c: F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[(<\[\"'“:=]$"), 1).when(c.rlike(r"^[)>\].,;!?”]$"), 2).otherwise(3)
    word = F.lower(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1))
    share = F.length(digits(raw)) / F.length(raw)
    return [
        vote(raw.rlike(FORMS[kind]), raw.rlike(MISFITS[kind])).alias("form"),
        vote(raw.rlike(KNOWN) | before.rlike(KNOWN), raw.rlike(NOBODY)).alias("gazetteer"),
        vote(before.rlike(CUES), before.rlike(AGAINST)).alias("context"),
        F.least(F.floor(F.length(raw) / 6).cast("int"), F.lit(5)).alias("size"),
        F.least(F.floor(share * 4).cast("int"), F.lit(3)).alias("digits"),
        side(F.right(before, F.lit(1))).alias("left"), side(after).alias("right"),
        F.when(word == "", 0).otherwise(1 + F.pmod(F.crc32(word.cast("binary")), F.lit(31))).cast("int").alias("word"),
    ]


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base (array of at, k, end) and wider (the same with votes and features), one row a text."""
    rows = df.select(F.col(id_col).alias("id"), F.translate(text_or_empty(text_col), MARK, OTHER).alias("clean"))
    rows = rows.select("id", *[pieces(F.col("clean"), kind).alias(f"p{k}") for k, kind in enumerate(KINDS)])
    add = lambda a, x: a + x
    several = lambda k: F.size(f"p{k}") > 1
    rows = rows.select("*", *[F.when(several(k), running(F.transform(f"p{k}", lambda x: F.length(x)), 0, add)).alias(f"e{k}") for k in range(len(KINDS))])
    span = "at: int, k: int, end: int"
    more = "".join(f", {c}: int" for c in (*LABELERS, *[f for f in FEATURES if f != "k"]))
    empty = lambda kind: F.expr(f"cast(array() as array<struct<{span}{'' if kind in BASE else more}>>)")
    rows = rows.select("id", *[F.coalesce(F.when(several(k), spans_of(k, kind)), empty(kind)).alias(f"s{k}") for k, kind in enumerate(KINDS)])
    joined = lambda kinds: F.array_sort(F.concat(*[F.col(f"s{KINDS.index(kind)}") for kind in kinds]))
    return rows.select("id", joined(BASE).alias("base"), joined(WIDER).alias("wider"))


def reliabilities(counts: DataFrame, rounds: int = 30, settled: float = 1e-3) -> Column:
    """counts: kind, votes and n, a row a pattern. The posterior probability of personal, as an expression of kind and
    votes, by expectation-maximisation. Pseudo-votes say that a labeler is right four times in five, and that half of a
    kind's candidates are personal."""
    sure = {name: [0.8, 0.8] for name in LABELERS}  # right on others, right on personal ones
    share = dict.fromkeys([KINDS.index(k) for k in WIDER], 0.5)

    def posterior() -> Column:
        odds = F.create_map(*[x for k, p in share.items() for x in (F.lit(k), F.lit(math.log(p / (1 - p))))])[F.col("k")]
        for name, (no, yes) in sure.items():
            odds = odds + F.when(F.col(name) == 1, math.log(yes / (1 - no))).when(F.col(name) == 2, math.log((1 - yes) / no)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    for _ in range(rounds):
        p, n = posterior(), F.col("n")
        sums = []
        for name in LABELERS:
            for c, w in enumerate((1 - p, p)):
                sums += [F.sum(F.when(F.col(name) == 2 - c, n * w)).alias(f"{name}{c}"), F.sum(F.when(F.col(name) > 0, n * w)).alias(f"{name}{c}_all")]
        for k in share:
            sums += [F.sum(F.when(F.col("k") == k, n * p)).alias(f"p{k}"), F.sum(F.when(F.col("k") == k, n)).alias(f"n{k}")]
        got = {key: x or 0.0 for key, x in counts.agg(*sums).first().asDict().items()}
        new = {name: [(got[f"{name}{c}"] + 8) / (got[f"{name}{c}_all"] + 10) for c in range(2)] for name in LABELERS}
        shares = {k: (got[f"p{k}"] + 1) / (got[f"n{k}"] + 2) for k in share}
        moved = max([abs(x - y) for name in LABELERS for x, y in zip(new[name], sure[name], strict=True)] + [abs(shares[k] - share[k]) for k in share])
        sure, share = new, shares
        if moved < settled:
            break
    return posterior()


def classifier(counts: DataFrame, posterior: Column) -> tuple[float, dict[str, list[float]]]:
    """Naive Bayes over the features, taught by posteriors: the log odds of personal, and their change by each value."""
    yes, no = F.sum(F.col("n") * posterior), F.sum(F.col("n") * (1 - posterior))
    whole = counts.agg(yes.alias("yes"), no.alias("no")).first()
    p, q = (whole["yes"] or 0.0) + 1, (whole["no"] or 0.0) + 1
    long = counts.withColumn("posterior", posterior).select("n", "posterior", F.posexplode(F.array(*[F.col(f) for f in FEATURES])).alias("feature", "value"))
    seen = long.groupBy("feature", "value").agg(F.sum(F.col("n") * F.col("posterior")).alias("yes"), F.sum(F.col("n") * (1 - F.col("posterior"))).alias("no"))
    held = {(r["feature"], r["value"]): r for r in seen.collect()}  # a row for each value of a feature
    weights = {}
    for i, (name, size) in enumerate(FEATURES.items()):
        rows = [held.get((i, v)) for v in range(size)]
        weights[name] = [math.log((r["yes"] + 1) / (p + size) / ((r["no"] + 1) / (q + size))) if r else 0.0 for r in rows]
    return math.log(p / q), weights


def apart(base: Column, wider: Column) -> Column:
    """The wider spans that overlap no base span. Both arrays are sorted; so is their union, with running ends of the base
    spans so far and running starts of those to come."""
    mine = lambda s: s["k"] < len(BASE)
    plain = lambda a: F.transform(a, lambda s: F.struct(s["at"].alias("at"), s["k"].alias("k"), s["end"].alias("end")))
    every = F.array_sort(F.concat(plain(base), plain(wider)))
    ends = running(F.transform(every, lambda s: F.when(mine(s), s["end"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
    far = (1 << 31) - 1
    starts = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(mine(s), s["at"]).otherwise(far))), far, lambda a, x: F.least(a, x)))
    met = F.arrays_zip(every.alias("s"), ends.alias("e"), starts.alias("b"))
    free = F.filter(met, lambda x: ~mine(x["s"]) & (x["e"] <= x["s"]["at"]) & (x["b"] >= x["s"]["end"]))
    return F.when((F.size(base) > 0) & (F.size(wider) > 0), F.transform(free, lambda x: x["s"])).otherwise(plain(wider))


def find_personal(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row."""
    rows = materialise(candidates(df, id_col, text_col))
    each = rows.select(F.explode("wider").alias("s")).select("s.*")
    counts = materialise(each.groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n")))
    votes = materialise(counts.groupBy("k", *LABELERS).agg(F.sum("n").alias("n")))
    odds, weights = classifier(counts, reliabilities(votes))
    table = {name: F.array(*[F.lit(w) for w in ws]) for name, ws in weights.items()}

    def accepted(s: Column) -> Column:
        total = F.lit(odds)
        for name in FEATURES:
            total = total + F.get(table[name], s[name])
        return total >= math.log(threshold / (1 - threshold))

    out = rows.select("id", "base", F.filter("wider", accepted).alias("wider"))
    out = out.select("id", "base", apart(F.col("base"), F.col("wider")).alias("added"))
    kind = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["k"] + 1), s["at"].cast("string"), s["end"].cast("string"))), ",")

    n = [F.size(F.filter("base", partial_of(lambda k, s: s["k"] == k, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return out.select(F.col("id").alias("doc_id"), *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
