"""Entities of any length, secrets without digits, IPv6, and names without titles."""

import random
import time

import pytest

from quarry.llm import pii
from tests.llm.cases import DOCS, words


def replaced(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    rows = pii.replace_pii(docs, "k").collect()
    return [(r.text, r.n_entities) for r in sorted(rows, key=lambda r: r.doc_id)]


LONG = {
    "word after a title": "Mr A" + "a" * 1_000_000,
    "apostrophes after a title": "Mr A" + "'a" * 50_000,
    "domain": "x@" + "a." * 500_000 + "com",
    "domain without an end": "x@" + "a." * 500_000 + "1",
    "titles": "Mr " * 330_000 + "Smith 1",
    "titles alone": "Mr " * 330_000,
    "local part": "a" * 100_000 + "@b.com",
    "secret": "token: " + "ab1" * 30_000,
    "keywords": "token=" * 160_000,
    "key": "sk-" + "a1" * 50_000,
    "hex": "0f" * 50_000,
    "digits": "1" * 1_000_000,
    "colons": "1:" * 500_000,
    "supplementary letters": "x@" + "\U0001d4b3a" * 25_000 + ".\U0001d4b3a" * 9,
}


@pytest.mark.parametrize("name", LONG)
def test_long_runs(spark, name):
    text = LONG[name]
    began = time.time()
    [(new, n)] = replaced(spark, [text])
    assert len(new) == len(text) and time.time() - began < 120
    none = {"titles alone", "domain without an end", "keywords", "colons"}
    assert (new == text) == (n == 0) == (name in none)


def test_secrets_and_keys_of_any_shape(spark):
    digits_late = "token: " + "abcdefgh" * 40 + "7 and on"
    out = replaced(spark, [
        "password: hunterabcdef", "PWD=abcdefghij.", digits_late, "secret: something or other", "token: abc.defgh@foo.com",
        "ghp_" + "a" * 24, "the token: wonderful, api_key = zz11zz11zz",
    ])
    assert out[0][1] == 1 and "hunterabcdef" not in out[0][0] and out[0][0].startswith("password: ")
    assert out[1][1] == 1 and out[2][1] == 1 and out[2][0].endswith(" and on") and "abcdefgh" * 40 not in out[2][0]
    assert out[3] == ("secret: something or other", 0)
    assert out[4][1] == 1 and out[4][0].startswith("token: ") and out[4][0].endswith(".com") and "defgh" not in out[4][0]
    assert out[5][1] == 1 and out[6][1] == 1 and "wonderful" in out[6][0]


def test_ipv6(spark):
    import ipaddress

    same = ["2001:db8:85a3::8a2e:370:7334", "fe80::1", "2001:0DB8:0000:0000:0000:ff00:0042:8329", "::1"]
    out = replaced(spark, [f"from {a}, again {a.lower()}." for a in same])
    for a, (text, n) in zip(same, out):
        first, second = text.removesuffix(".").removeprefix("from ").split(", again ")
        assert n == 2 and first.lower() == second and first != a
        assert ipaddress.IPv6Address(first) != ipaddress.IPv6Address(a)
    clean = ["std::vector a::b ::", "at 10:20:30 or 1:2", "ab:cd:ef:01:23:45", "C::D::E"]
    assert replaced(spark, clean) == [(c, 0) for c in clean]


def test_names_without_a_title(spark):
    [(a, n), (b, _), (c, _)] = replaced(
        spark, ["John Smith lives here, call John. Mr Smith did.", "Анна Петрова. Петрова", "John lives; Smith too."]
    )
    assert n == 3 and "John" not in a and "Smith" not in a
    given, last = a.split()[:2]
    assert given in pii.GIVEN_NAMES[1] and a == f"{given} {last} lives here, call {given}. Mr {last} did."
    assert "Анна" not in b and "Петрова" not in b and b.split()[0] in pii.GIVEN_NAMES[2]
    assert c == "John lives; Smith too."


def planted(seed, count, given, title=""):
    """Texts with one name among ordinary words each."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        first = rng.choice(given)
        last = "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize()
        out.append((f"{words(seed + i, 20)} {title}{first} {last} {words(seed + i + 1, 20)}", first, last))
    return out


def test_share_of_planted_names_found(spark):
    listed = [n for names in pii.GIVEN_NAMES for n in names]
    unlisted = ["Wolfgang", "Priya", "Yuki", "Chloe", "Kwame", "Ingrid", "Владимир", "Fatima"]
    found = {}
    for kind, rows in {
        "titled": planted(1, 100, listed + unlisted, "Dr. "),
        "listed": planted(2, 100, listed),
        "unlisted": planted(3, 100, unlisted),
    }.items():
        out = replaced(spark, [t for t, _, _ in rows])
        found[kind] = sum(last not in text for (text, _), (_, _, last) in zip(out, rows))
    assert found == {"titled": 100, "listed": 100, "unlisted": 0}
