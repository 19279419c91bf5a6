import hashlib
import random
import re

from lexiforge.llm import secret_scan as ss

from .cases import SCHEMA, TEXTS, rows

WORDS = ["password", "passwd", "SECRET", "Token", "api_key", "apiKey"]
ASSIGN = re.compile(r"""(?:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")))


def brute(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    kinds = ("assign", "access", "hex")
    said = [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found)]
    return *(sum(k == x for _, k, _ in found) for x in range(3)), said


def texts():
    rng = random.Random(5)
    parts = WORDS + ["=", ":", ' "', "'", " ", "\n", "é🎉", "AKIA", "ABCDEFGHIJKL0123", "0123456789abcdef", "deadbeef" * 4, "xyz", "abcdefgh", "long.value_here", "ſecret=12345678"]
    return TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(200)]


def test_base_equals_brute_force(spark):
    all_ = texts()
    got = {r.doc_id: r for r in ss.scan_secrets(spark.createDataFrame(rows(all_), SCHEMA)).collect()}
    for i, t in enumerate(all_):
        *counts, said = brute(t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(counts), t
        assert got[i].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest(), t
        assert set(said) <= {*got[i].spans.split(","), ""}
        assert len(list(filter(None, got[i].spans.split(",")))) == sum(counts) + got[i].n_random


RANDOM = "kJ8sXq2LmZ0pRt7WvB4nYc9dHf3G"
PLAIN = [
    "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "internationalization-of-words", "customer_order_line_item_2024",
    "thentiononatingthewhereof", "2024-01-31-12-00-00-000", "MAX_RETRY_COUNT_DEFAULT",
]


def test_token_efficiency():
    path = ss.default_vocabulary()
    assert ss.is_random(RANDOM.encode(), path)
    assert not any(ss.is_random(p.encode(), path) for p in PLAIN)


def test_keys_of_letters_only():
    path, rng = ss.default_vocabulary(), random.Random(8)
    upper_lower = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    caught = lambda letters, n: sum(ss.is_random("".join(rng.choices(letters, k=n)).encode(), path) for _ in range(200))
    assert caught(upper_lower, 24) >= 196 and caught(upper_lower, 40) >= 196 and caught(upper_lower[:26], 24) >= 180
    assert not any(ss.is_random(p, path) for p in (b"customerOrderLineItem", b"InternationalOrderService", b"antidisestablishmentarianism"))


def test_redaction(spark):
    cases = [f"key {RANDOM} end", "clean é text", None, "token = abcdefgh12 and " + "0f" * 20, "é password: " + "ab" * 16]
    df = spark.createDataFrame(rows(cases), SCHEMA)
    out = ss.redact_secrets(df)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(5)] == ["key [SECRET] end", "clean é text", None, "[SECRET] and [SECRET]", "é [SECRET]"]
    assert got[0].n_chars == len(got[0].text) and got[2].n_chars == 0
    assert ss.scan_secrets(df.limit(0)).count() == 0 and ss.redact_secrets(df.limit(0)).count() == 0
