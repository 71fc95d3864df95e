"""High-entropy strings directly after an equals sign, and long ones whose kinds of characters come late."""

import random
import string

from ferrule.llm import secrets


def test_strings_after_equals_and_late_kinds(spark):
    rnd = random.Random(9)
    key = "aB3" + "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(40))
    late = "".join(rnd.choice(string.ascii_lowercase + string.digits) for _ in range(700)) + key
    texts = [(f"KEY={key}\n", key), (f"https://x.example/a?sig={key}&b=1", key), (f"x {late} y", late), (f"MD={'0a1b2c3d4e5f' * 2} .", "0a1b2c3d4e5f" * 2)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [t[s.start : s.end] for s in r.extra] for r in secrets.scan(docs).collect() for t in [texts[r.doc_id][0]]}
    assert got == {i: [want] for i, (_, want) in enumerate(texts)}
