"""SimHash of texts in the task that holds them."""

import hashlib

from pyspark.sql import functions as F

from cohortspark.sources import fixtures as X


def by_hand(text):
    words = {w for w in (text or "").lower().split(" ") if w}
    v = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    return sum(1 << i for i in range(32) if sum((x >> i & 1) * 2 - 1 for x in v) > 0)


def test_simhash_shuffles_nothing(spark):
    texts = ["", None, "A a b  c", "ä Ö\tx", " ", "one two three four five six", "x"]
    out = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", X.simhash(F.col("text")).alias("h"))
    assert {r.id: r.h for r in out.collect()} == {k: by_hand(t) for k, t in enumerate(texts)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and not out.schema["h"].nullable
