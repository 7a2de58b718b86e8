"""Licenses by version, copy and offset; secrets by alphabet, length and prefix."""

import random
import string
import time

from gridloom.llm import licenses, secrets

T = licenses.Templates(licenses.TEMPLATES)
FILL = [f"w{i}" for i in range(997)]


def found(text):
    return [m[0] for m in licenses.scan([text.encode()], T, 0.8, {})[0]]


def test_versions_and_clauses():
    t = licenses.TEMPLATES
    for name in ("gpl-2.0-only-header", "gpl-3.0-only-header", "lgpl-2.0-header", "bsd-4-clause", "cc-by-3.0-notice", "cc-by-sa-3.0-notice", "gfdl-1.3-notice", "gpl-2.0-header", "bsd-3-clause"):
        assert found(t[name]) == [name]
    assert found(t["gpl-2.0-header"].replace("version 2", "version 1")) == []
    assert found(t["apache-2.0-header"].replace("Version 2.0", "Version 1.1")) == []
    assert found(t["lgpl-2.1-header"].replace("version 2.1", "version 2.2")) == []
    assert found(t["cc-by-4.0-notice"].replace("4.0", "2.5")) == []


def test_copies_one_after_another():
    grant = licenses.TEMPLATES["mit-grant"]
    n = len(grant.split())
    began = time.time()
    got = licenses.scan([" ".join([grant] * 20_000).encode()], T, 0.8, {})[0]
    assert time.time() - began < 60
    assert len(got) == 20_000 and {m[0] for m in got} == {"mit-grant"}
    starts = [m[1] for m in got]
    assert len(set(b - a for a, b in zip(starts, starts[1:], strict=False))) == 1 and got[-1][2] <= 20_000 * 2 * n
    mixed = [licenses.TEMPLATES[k] for k in ("mit-grant", "isc", "mit-grant", "zlib")]
    assert found(" x ".join(mixed)) == ["mit-grant", "isc", "mit-grant", "zlib"]


def test_every_offset():
    for name, words in (("zlib", 64), ("isc", 64), ("epl-2.0", 16), ("bsd-2-clause", 60), ("apache-2.0-header", 60)):
        own = licenses.TEMPLATES[name].split()
        half = len(own) // 3
        text = own[:half] + FILL[:words] + own[half:]
        assert all(name in found(" ".join(FILL[:k] + text + FILL[:50])) for k in range(260)), name


def test_recall_of_keys():
    """Random keys, bare and after fixed prefixes, in a sentence."""
    rng = random.Random(6)
    sets = {"hex": "0123456789abcdefABCDEF", "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/_-"}
    for kind, letters in sets.items():
        for n in (24, 36, 40):
            for prefix in ("", "ghp_", "sk-", "sk_live_", "xoxb-"):
                keys = [prefix + "".join(rng.choices(letters, k=n)) for _ in range(300)]
                # a base span within the key stands for it: runs that meet base spans aren't added
                share = sum(bool(base) or (5, 3, 5 + len(k)) in added for k in keys for base, added in [secrets.scan(f"use: {k} here")]) / 300
                assert share >= (0.93 if n == 24 else 0.97), (kind, n, prefix, share)
    assert secrets.scan("ghp_16C7e42F292c6912E7710c838347Ae178B4a")[1] and secrets.scan("16C7e42F292c6912E7710c838347Ae178B4a")[1]


def test_public_values_stay():
    for text in ("123e4567-e89b-12d3-a456-426614174000", "a-very-long-hyphenated-identifier-name", "some_function_name_with_2_numbers_in_it", "https://example.com/some/long-article-about-water-2024", "AAAAAAAAAAAAAAAAAAAAAAAAAAAA", *secrets.PUBLIC):
        assert secrets.scan(text)[1] == [], text
