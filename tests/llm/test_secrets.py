import hashlib
import math
import random
import re
import string

from cases import EDGES, SCHEMA, prose, table
from oracle import differences
from pyspark.sql import functions as F

from lodestar.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """(start, kind, stop) by plain loops."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def masked(text):
    for pattern, ok in ((ASSIGN, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        text = pattern.sub(lambda m: " " * len(m[0]) if ok(m) else m[0], text)  # noqa: B023
    return text


def judged(s):
    """(class, step, uniform) of a candidate, or None."""
    alphabet = next((a for p, a in secrets.ENCODINGS if re.search(p, s)), None)
    if alphabet is None:
        return None
    n, k = len(s), len(alphabet)
    v = [alphabet.index(c) + 1 for c in s]
    squares = sum(s.count(c) ** 2 for c in set(s))
    chi = (k * squares / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [x > k // 2 for x in v]
    ones = sum(high)
    mu = 2 * ones * (n - ones) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    s1, s2, sx = sum(v), sum(x * x for x in v), sum(a * b for a, b in zip(v, v[1:] + v[:1], strict=True))
    usual = max(2 / k, 0.06)
    text = (squares - n - n * (n - 1) * usual) / math.sqrt(2 * n * (n - 1) * usual * (1 - usual))
    step = max(-1000, min(0, math.ceil(text * 50)))
    if var <= 0 or n * s2 == s1 * s1:
        uniform = False
    else:
        serial = ((n * sx - s1 * s1) / (n * s2 - s1 * s1) + 1 / (n - 1)) * (n - 1) * math.sqrt(n - 2) / n
        uniform = chi**2 + (runs - mu) ** 2 / var + serial**2 <= 16.266
    return sum(n >= x for x in (32, 64, 128)), step, uniform


def expected(rows, share=0.01):
    spans, tested, strings = [], [], {}
    for key, text in rows:
        own = masked(text or "")
        found = [(m.start(), m.end(), judged(m[0]), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", own)]
        tested.append([f for f in found if f[2]])
        for *_, j, s in tested[-1]:
            strings.setdefault(j[0], {})[s] = j[1]
    limit = {}
    for size, steps in strings.items():
        for step in set(steps.values()):
            p = 0.5 * math.erfc(-step / 50 / math.sqrt(2))
            if p <= share * sum(x <= step for x in steps.values()) / len(steps):
                limit[size] = max(step, limit.get(size, -9999))
    for (key, text), own in zip(rows, tested, strict=True):
        first = base(text or "")
        show = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
        random_ = [(a, 3, b) for a, b, (size, step, uniform), _ in own if uniform and step <= limit.get(size, -9999)]
        spans.append((key, *[sum(k == kind for _, k, _ in first) for kind in range(3)], hashlib.sha256(show(first).encode()).hexdigest(), show(first + random_)))
    return sorted(spans, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def drawn(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def planted():
    """Texts with secrets of all kinds, traps, and long strings that are no secrets."""
    r = random.Random(3)
    base64, alnum = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    rows = []
    for k in range(60):
        text = prose(k, 40)
        if k % 3 == 0:
            text += " key " + drawn(r, base64, r.choice((32, 40, 44, 64, 88, 150))) + " end"
        if k % 4 == 0:
            text += " é " + drawn(r, alnum, 40) + "\n" + "camelCaseIdentifierOfSomeLength" + "Again" * (k % 3)
        if k % 5 == 0:
            text += ' Token = "' + drawn(r, "0123456789abcdef", 40) + '" PASSWORD:abc secret= longEnough_value token=token:abcdefgh'
        if k % 7 == 0:
            text += " AKIA" + drawn(r, string.ascii_uppercase + string.digits, 16) + " AKIASHORT " + "abcdef" * 5 + " " + "/usr/local/lib/some/long/path/of/a/program" + " " + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        rows.append((k, text))
    return rows


ODD = [(900, "x" * 500), (901, "-" * 30 + "_" * 30), (902, "0" * 64), (903, "paſsword=abcdefgh toKen=abcdefgh"), (904, "api_key='abc' apikey = \"abcdef.g=\""), (905, "\U0001f600" * 3 + " token=abcdef\U0001f600"), (906, "+/-_" * 10), (907, "secret" * 9 + "=123456")]


def test_base_and_random_spans(spark):
    rows = EDGES + planted() + ODD
    got, want = found(secrets.scanned(table(spark, rows))), expected(rows)
    assert got == want
    assert sum("random" in r[-1] for r in want) >= 20


def test_secrets_are_found_and_identifiers_are_not(spark):
    spans = {r.doc_id: r.spans for r in secrets.scanned(table(spark, planted())).collect()}
    texts = dict(planted())
    caught = [texts[k][int(a) : int(b)] for k, s in spans.items() for kind, a, b in [x.split(":") for x in s.split(",") if x] if kind == "random"]
    assert len(caught) >= 20 and not any(c.startswith(("camel", "/usr", "abcdef")) for c in caught)


def test_equal_to_its_sql_on_planted_secrets(spark, tmp_path):
    table(spark, planted() + ODD[1:3] + ODD[4:]).write.parquet(str(tmp_path / "t"))
    import glob

    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(glob.glob(str(tmp_path / "t/*.parquet"))), tmp_path / "documents.parquet")
    assert differences(queries.op13_secrets(spark, str(tmp_path)), queries.SQL["op13_secrets"], str(tmp_path)) == ""


def test_many_spans_in_a_long_text(spark):
    r = random.Random(5)
    text = " ".join(f"token={drawn(r, string.ascii_letters, 8)} {'é' * (k % 5)} {drawn(r, '0123456789abcdef', 24)}" for k in range(4000))
    rows = [(1, text), (2, "0123456789abcdef" * 4000)]
    assert found(secrets.scanned(table(spark, rows))) == expected(rows)


def test_sums_before(spark):
    df = spark.createDataFrame([([],), ([3],), (list(range(1000)),), ([1] * 70_000,)], "n array<int>")
    for r in df.select("n", secrets.before(F.col("n")).alias("s")).collect():
        at, want = 0, []
        for x in r.n:
            want.append(at)
            at += x
        assert r.s == want


def test_empty_table_and_clashing_names(spark):
    df = secrets.scanned(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and df.count() == 0
    named = table(spark, EDGES).selectExpr("doc_id AS spans", "text AS base", "'x' AS key", "'y' AS candidates", "'z' AS rest")
    got = secrets.scanned(named, key="spans", text="base").select(F.col("n_hex"), F.col("base_sha256"))
    assert got.count() == len(EDGES)


def test_no_python_in_the_plan(spark):
    from io import StringIO
    from contextlib import redirect_stdout

    with redirect_stdout(StringIO()) as out:
        secrets.scanned(table(spark, planted())).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
