from pyspark.sql import functions as F

from transcriptlab.llm import toxicity


def test_rows_beyond_the_start_count(spark):
    """A word that only rows outside the bounded start show to be toxic; the same model however the table is cut."""
    c = toxicity.Config(sample_toxic=20, sample_clean=20, shard_rows=800)
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    drawn = labels.withColumn("draw", F.abs(F.xxhash64(F.lit(c.seed), "doc_id") % 1_000_000_007)).filter(~toxicity.held_out(F.col("doc_id")))
    early = {r.doc_id for r in drawn.filter("toxic = 1").orderBy("draw", "doc_id").limit(20).collect()}
    word = F.when(F.col("toxic") == 0, "kind").when(F.col("doc_id").isin(*early), "nasty").otherwise("vile")
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.crc32(F.concat("doc_id", F.lit(f":{i}")).cast("binary")) % 200) for i in range(10)], word)
    data = labels.select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    model = toxicity.train(data, labels, c)
    right = toxicity.score(data, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97
    again = toxicity.train(data.repartition(7), labels, c)
    assert abs(again.embedding - model.embedding).max() < 1e-9 and abs(again.shift - model.shift) < 1e-6


def test_rows_without_a_label_are_sorted_out(spark, monkeypatch):
    """All rows of the ids stay, hardly any other does; also where the map is nearly full, or a key is null."""
    rows = spark.range(200_000).select(F.when(F.col("id") > 0, F.col("id") - 5).alias("doc_id"), F.lit("x").alias("text"))
    ids = rows.filter("doc_id % 10 = 3").select("doc_id")
    got = {r.doc_id for r in toxicity.perhaps_among(rows, ids).collect()}
    want = {r.doc_id for r in ids.collect()}
    assert want <= got and len(got) < 1.05 * len(want)
    monkeypatch.setattr(toxicity, "MAP_BITS", 1 << 15)
    assert want <= {r.doc_id for r in toxicity.perhaps_among(rows, ids).collect()}
