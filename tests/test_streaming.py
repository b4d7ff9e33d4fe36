"""The streaming summary ends as the batch one."""

from helixaudit.operators import leakage
from helixaudit.sources.hits import HIT_SCHEMA, read_hits
from helixaudit.streaming import hits as stream

ROW = "seq_{q}_test\tseq_{t}_train\t1.0\t{c}\t{p}\t0.1\t1\t4\t1\t4\t4\tACGT\tACGT"


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "hits"
    folder.mkdir()
    header = "\t".join(f.name for f in HIT_SCHEMA)
    for k in range(3):
        (folder / f"{k}.tsv").write_text("\n".join([header] + [ROW.format(q=i % 4, t=i, c=0.5 + 0.1 * k, p=90 + i + k) for i in range(7)]) + "\n")
    query = stream.best_so_far(stream.hit_stream(spark, str(folder))).writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = read_hits(spark, str(folder))
    assert sorted(map(tuple, spark.table("best").collect())) == sorted(map(tuple, leakage.best_similarity(batch).collect()))
    stream.keep_leaks(stream.hit_stream(spark, str(folder)), str(tmp_path / "leaks"), str(tmp_path / "state"), 60.0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "leaks")).count() == leakage.leaked_hits(batch, 60.0).count() > 0
