from cuefold.plans.media import reading_order


def test_every_value_of_a_vector_is_in_a_box(spark, tmp_path):
    # Each box is a row of its own, the last one on top.
    rows = [(1, [x for k in range(32) for x in (float(k), 0.0)]), (2, []), (3, None), (4, [1.0, 2.0, 3.0])]
    spark.createDataFrame(rows, "vec_id int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.ids for r in reading_order(spark, str(tmp_path)).collect()}
    assert got[1] == ",".join(str(k) for k in range(31, -1, -1))
    assert (got[2], got[4]) == ("", "0") and not got[3]
