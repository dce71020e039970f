"""Gram matrix over all channels, attention with all of a group's rows as keys."""

import duckdb
import numpy as np

from framelake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_whole_gram_and_attention(spark):
    pdf = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name, keys in (("a34_gram_channels", 3), ("a43_attention_positions", 2)):
        got = {tuple(r)[:keys]: r[keys] for r in QUERIES[name](spark, SF).collect()}
        want = {r[:keys]: r[keys] for r in con.sql(ORACLES[name]).fetchall()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
        if keys == 3:
            for label, group in pdf.groupby("label"):
                v = np.stack(group.embedding).astype(float)
                g = v.T @ v / len(v)
                assert all(abs(got[label, i, j] - g[i, j]) < 2e-6 for i in range(64) for j in range(i, 64))
        else:
            for vec_id, e in zip(pdf.vec_id, pdf.embedding):
                h = np.array(e, float).reshape(8, 8)
                w = np.exp(h @ h.T / 8**0.5)
                assert np.allclose([got[vec_id, i] for i in range(8)], w @ h[:, 0] / w.sum(1), atol=2e-6)
