"""Personal data and secrets against plain regular expressions."""

import hashlib
import random
import re

from quantloom.llm import pii, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    ]
    return sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))


def base_secrets(text):
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    ]
    return sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


def texts(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


PARTS = ["a.b@c.de", "@", "x@y", ".com", "_d@e.f", " ", "-", "4111 1111 1111 1111", "4111-1111-1111-1111", "7", "42", "0", ".", "1.2.3.4", "256.1.1.1", "+1 (415) 555-2671", "+", "(", "é", "\U0001f600", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "ssn ", "00000001", "\n"]
SECRETS = ["password", "Token", "API_KEY", "apikey", "secret", "=", ": ", '"', "'", " ", "abc123", "deadbeef" * 3, "AKIA", "ABCDEFGHIJ123456", "a", "0f", "Z", "é", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "-----BEGIN RSA PRIVATE KEY-----", "\n"]


def check(found, expected, rows, names):
    assert len(found) == len(rows)
    for r in found:
        spans = expected(rows[r.doc_id] or "")
        joined = ",".join(s[2] for s in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (rows[r.doc_id], joined, r.spans)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        for k, name in enumerate(names):
            assert r[f"n_{name}"] == sum(s[1] == k for s in spans)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}", 1) for i, t in enumerate(rows)], SCHEMA)


def test_personal_data_against_regex(spark):
    rows = [None, "", "9" * 50_000, "a" * 100_000, "1 2 " * 20_000, "x@" + "a." * 20_000 + "b", "+1" + " " * 50_000 + "2", *texts(PARTS, 1500, 3)]
    found = pii.personal_data(frame(spark, rows)).collect()
    check(found, base_pii, rows, ["email", "ip", "card", "phone"])
    one = pii.personal_data(frame(spark, ["pay to DE89370400440532013000 or GB82 WEST 1234 5698 7654 32, ssn 123-45-6789", "DE89370400440532013001 123-45-6789"])).orderBy("doc_id").collect()
    assert [s.split(":")[0] for s in one[0].spans.split(",")] == ["iban", "iban", "ssn"] and one[1].spans == ""


def test_personal_data_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 1), (1, "a@b.cd", 2), (None, "a@b.cd", 3)], "doc_id long, text string, row long")
    assert sorted(str(r.doc_id) for r in pii.personal_data(docs).collect()) == ["1", "1", "None"]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_secrets_against_regex(spark):
    rows = [None, "", "f" * 50_000, "token" + " " * 50_000, *texts(SECRETS, 1500, 5)]
    check(secrets.secrets(frame(spark, rows)).collect(), base_secrets, rows, ["assign", "access", "hex"])


def test_ownership_separates_examples(spark):
    rows = [f"password = example123 {i}" for i in range(8)] + ["password = onlyhere1"]
    found = secrets.secrets(frame(spark, rows)).orderBy("doc_id").collect()
    assert [(r.n_live, r.n_example) for r in found] == [(0, 1)] * 8 + [(1, 0)]


def test_repositories_separate_examples_too(spark):
    most = secrets.EXAMPLE_REPOSITORIES
    rows = [("hot", "password = onesource1")] * most + [("hot", "password = fewplaces1")] * (most - 1) + [(f"s{i % 2}", "password = twosource1") for i in range(most)] + [("hot", "password = alone11 token = onesource1")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, (s, t) in enumerate(rows)], SCHEMA)
    found = [(r.n_live, r.n_example, r.spread) for r in secrets.secrets(docs).orderBy("doc_id").collect()]
    assert found == [(0, 1, f"1:{most + 1}")] * most + [(1, 0, f"1:{most - 1}")] * (most - 1) + [(0, 1, f"2:{most}")] * most + [(1, 1, f"1:1,1:{most + 1}")]


def test_null_owners_and_repositories_stay_apart(spark):
    """A null owner is one owner, not the empty one; three owners make an example."""
    rows = [(1, "password = threeown1", None), (2, "password = threeown1", ""), (3, "password = threeown1", "s"), (4, "password = nullonly1", None), (5, "password = nullonly1", None), (None, "password = nullrepo1", "s"), (None, "password = nullrepo1", "s"), (6, "password = nullrepo1", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted((r.doc_id or 0, r.n_live, r.n_example, r.spread) for r in secrets.secrets(docs).collect())
    assert found == [(0, 1, 0, "1:2"), (0, 1, 0, "1:2"), (1, 0, 1, "3:3"), (2, 0, 1, "3:3"), (3, 0, 1, "3:3"), (4, 1, 0, "1:2"), (5, 1, 0, "1:2"), (6, 1, 0, "1:2")]


def test_secrets_on_awkward_tables(spark):
    """Repeated rows count as one repository each id; columns with the operator's own names are ignored."""
    rows = [(1, "token = abcdef1", "s", 1, "x")] * 12 + [(2, None, None, 2, None), (3, "", "s", 3, "y"), (4, "x" * 200_000 + " token = tailend1", "s", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, kind string").selectExpr("*", "row as start", "kind as owner", "kind as value", "row as shared", "kind as hit")
    found = sorted((r.doc_id, r.n_assign, r.n_live, r.spread) for r in secrets.secrets(docs).collect())
    assert found == [(1, 1, 1, "1:1")] * 12 + [(2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 1, "1:1")]
    assert secrets.secrets(docs.limit(0)).count() == 0
