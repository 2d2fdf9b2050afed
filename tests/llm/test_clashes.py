"""Extra columns, named as what the operators use inside, change nothing."""

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

from keyroll.llm import chat, decontaminate, jaccard_join, langid, quality, token_files
from keyroll.llm.queries import tokenizer_path
from tests.llm.conftest import prose

NAMES = ("row", "written", "fp", "n", "cl", "token", "tie", "key", "matches", "o", "share", "score", "lang_pred", "shard",
         "label", "h1", "block", "g", "node", "body", "index", "_id", "_dropped_id", "t", "start", "tokens")


def clashing(frame):
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in frame.columns])


def corpus(seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(12)]
    return [*enumerate(texts), (20, texts[3]), (21, texts[4] + " more"), (22, None), (23, "")]


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_classifiers(docs):
    plain = docs(corpus(1))
    odd = clashing(plain)
    labels = plain.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    weights = quality.train(plain, labels)
    assert (quality.train(odd.drop("label"), labels) == weights).all()
    assert rows(quality.score(odd, weights)) == rows(quality.score(plain, weights))
    profiles = langid.learn(plain)
    assert [(n, p.tolist()) for n, p in langid.learn(odd)] == [(n, p.tolist()) for n, p in profiles]
    assert rows(langid.predict(odd, profiles)) == rows(langid.predict(plain, profiles))


def test_chat(spark):
    turns = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(3 + c)],
                                  "conv_id long, turn long, role string, text string")
    odd = turns.select("*", *[F.lit(0).alias(n) for n in ("conv", "h1", "h2", "s", "copies", "last", "m", "r", "end")])
    assert rows(chat.render(odd)) == rows(chat.render(turns)) and chat.render(odd).count() == 1


def test_benchmark_and_copies(spark, docs):
    plain = docs([*corpus(2), (30, "a benchmark item of ten words stands here in full.")])
    odd = clashing(plain)
    items = spark.createDataFrame([(1, "a benchmark item of ten words stands here in full.")], "item_id long, text string")
    found = decontaminate.find(odd, items)
    assert {r["row"]["doc_id"] for r in found.collect() if r["matches"]} == {30}
    assert found.select("row.*").columns == odd.columns
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert rows(jaccard_join.components_of(odd)) == rows(jaccard_join.components_of(plain))
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and rows(kept.select("doc_id")) == rows(jaccard_join.keep_one(plain).select("doc_id"))


def test_token_files(docs):
    plain = docs(corpus(3))
    assert rows(token_files.read_files(token_files.write_files(clashing(plain), tokenizer_path()))) == rows(
        token_files.read_files(token_files.write_files(plain, tokenizer_path())))


def test_pipeline_stages(spark, docs, table):
    """Nulls, ties and repeated rows too: all but the last stage keep the columns."""
    frame = clashing(docs([*corpus(4), *corpus(4)[:3], (None, prose(random.Random(9), 50))]))
    sf = table(documents=frame, benchmark=spark.createDataFrame([(1, None), (None, "x y z")], "item_id long, text string"))
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, frame, sf)
        assert out.columns == frame.columns, name
        frame = spark.createDataFrame(out.collect(), frame.schema)
    assert cp.run(spark, sf).count() == frame.count()
