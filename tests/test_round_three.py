"""Bodies of any length, lists of mail without copies of vectors, histograms of many rows at once."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sortbox.functions import mime as M
from sortbox.operators import nearest as NE


def test_long_bodies_are_decoded_in_one_look_at_each_character(spark):
    df = spark.createDataFrame([("QUJD",), ("QU\nJD é",), ("QU-_",), ("QUJ",), ("a!b#c$d%",), (None,)], "d string")
    got = df.select(M._alphabet_only(F.col("d")).alias("a"), M.decode_base64url(F.col("d")).alias("t")).collect()
    assert [r.a for r in got] == ["QUJD", "QUJD", "QU-_", "QUJ", "abcd", None]
    assert [r.t for r in got][:2] == ["ABC", "ABC"] and got[3].t == ""
    long = df.limit(1).select(F.repeat("d", 6_000_000).alias("d"))
    start = time.time()
    assert long.select(F.length(M.decode_base64url(F.col("d")))).first()[0] == 18_000_000
    assert time.time() - start < 12


def test_a_mail_that_many_lists_can_hold_is_there_once():
    r = np.random.default_rng(5)
    v = lambda n: pa.array(list(r.normal(size=(n, 16))), pa.list_(pa.float64()))
    mail = pa.table({"message_id": [f"m{i}" for i in range(3000)], "v": v(3000), "dim": [16] * 3000, "part": [0] * 3000})
    pivots = pa.table({"list": list(range(200)), "v": v(200), "least": [0.0] * 200, "largest": [2.0] * 200, "dim": [16] * 200, "part": [0] * 200})
    out = NE.reached(mail, pivots, 2.0)
    assert out.num_rows == 3000 and out.column("lists").to_pylist() == [list(range(200))] * 3000
    assert out.nbytes < 3000 * 200 * 16
    some = NE.reached(mail, pivots.set_column(3, "largest", pa.array(np.linspace(0, 1, 200))), 0.5)
    chords = NE._chords(NE._vectors(mail), NE._vectors(pivots))
    want = chords - np.linspace(0, 1, 200) <= np.minimum(chords.min(1), 0.5)[:, None] + NE.SLACK
    want &= -chords <= np.minimum(chords.min(1), 0.5)[:, None] + NE.SLACK
    assert some.column("lists").to_pylist() == [np.flatnonzero(w).tolist() for w in want]
    assert NE.reached(mail.slice(0, 0), pivots, 2.0).num_rows == 0
