"""Entropy spans of whole texts against brute force, long candidates, many matches, clashing names."""

import math
import random
import re
import string
from collections import Counter

from ferrule.llm import secrets


def brute_entropy(s, window=24):
    return max(-sum(c / window * math.log2(c / window) for c in Counter(s[i : i + window]).values()) for i in range(len(s) - window + 1))


def brute_spans(text):
    """All base and entropy spans of a text, by plain loops over Python's own matches."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for kind, (name, pattern, _, window, least) in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(pattern, text):
            if all(re.search(k, m[0]) for k in secrets.KINDS[name]) and not any(re.search(a, m[0]) for a in secrets.ALLOWED) and brute_entropy(m[0], window) >= least:
                spans.append((m.start(), kind, m.end()))
    return ",".join(f"{secrets.ORDER[k]}:{a}:{b}" for a, k, b in sorted(spans))


def random_text(rnd):
    pools = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits + "+/_-", "aB1", "ab", string.digits]
    glue = [" ", "=", "\n", "é", "🙂", "==", "=== ", ":", "\"", ", sha256-", " example", "token = ", "AKIA", "."]
    return "".join("".join(rnd.choice(pool) for _ in range(rnd.choice((3, 23, 24, 25, 31, 40, 70)))) + rnd.choice(glue) for pool in rnd.choices(pools, k=rnd.randint(1, 12)))


def test_spans_of_random_texts(spark, tmp_path):
    rnd = random.Random(7)
    texts = [random_text(rnd) for _ in range(400)] + [None, ""]
    rows = [(i, t, "k", 1, [1]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, start int, base array<int>").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in secrets.op5_secret_scan(spark, str(tmp_path)).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}
    assert sum("entropy_hex" in s for s in got.values()) > 20 and sum("entropy_base64" in s for s in got.values()) > 20


def test_long_candidates_and_many_matches(spark, tmp_path):
    rnd = random.Random(8)
    letters = (string.ascii_letters + string.digits).replace("x", "").replace("X", "")  # a long run of others may hold an allowed xxxx
    high = "aB3" + "".join(rnd.choice(letters) for _ in range(300_000))
    low = "aB3" * 20_000
    many = "".join(f"token = {k:08d} é " for k in range(30_000))
    spark.createDataFrame([(1, f"x {high} y"), (2, f"{low}."), (3, many)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.op5_secret_scan(spark, str(tmp_path)).collect()}
    assert got[1].spans == f"entropy_base64:2:{2 + len(high)}" and got[2].spans == ""
    assert got[3].n_assign == 30_000 and got[3].spans == ",".join(f"assign:{19 * k}:{19 * k + 16}" for k in range(30_000))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert secrets.op5_secret_scan(spark, str(tmp_path)).count() == 0
