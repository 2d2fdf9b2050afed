import random

import corpus_pipeline as cp
from keyroll.llm import decontaminate, mixing, rules
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_jaccard import edited
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_token_files import expected


def test_stages_against_brute_force(spark, docs, table):
    from tokenizers import Tokenizer

    from keyroll.llm.queries import tokenizer_path

    rng = random.Random(12)
    item = prose(rng, 40)
    good = [prose(rng, rng.randint(60, 150)) for _ in range(60)]
    rows = [(i, t, rng.choice(("en", "de")), f"src{i % 4}") for i, t in enumerate(good)]
    rows += [(100 + i, edited(rng, good[i], 0.01), "en", "src1") for i in range(5)] + [(110, good[7], "en", "src1")]
    rows += [(200, prose(rng, 5)), (201, "a b | " * 60), (202, None), (203, ""), (204, (prose(rng, 20) + " ") * 6)]
    rows += [(300, f"{prose(rng, 50)} {item} {prose(rng, 30)}"), (301, item)]
    sf = table(documents=docs(rows), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))

    frame, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, frame, sf)
        assert out.columns == frame.columns, name
        frame = spark.createDataFrame(out.collect(), frame.schema)
        seen.append({r["doc_id"] for r in frame.collect()})
    ids = set(range(60))
    assert seen[0] == ids | set(range(100, 105)) | {110, 300, 301}
    # One document of every component of what the rules left.
    left = brute_components([(i, t) for i, t, *_ in rows if i in seen[0]])
    assert seen[1] == {i for i, _, component in left if i == component} and seen[1] >= ids | {300, 301}
    assert 110 not in seen[1] and len(seen[1]) < len(seen[0]) - 1
    assert seen[2] == seen[1] - {300, 301}
    plain = [(i, f"d{int(s[3:]) % 3}", lang, s, len(t.split())) for i, t, lang, s in rows[:65] if i in seen[2]]
    want = brute_mix(plain, cp.WEIGHTS, (9, 10), 1)
    assert seen[3] == {i for i, _, _ in want} and 30 < len(seen[3]) < 60

    tokenizer = Tokenizer.from_file(tokenizer_path())
    kept = [(i, t) for i, t, *_ in rows if i in seen[3]]
    result = sorted(map(tuple, cp.run(spark, sf).collect()), key=lambda r: r[1])
    assert result == expected(tokenizer, kept)


def test_stages_are_the_ordered_operators():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "benchmark_leaks", "source_mix", "token_files"]
    assert rules.WINDOW == 8 and decontaminate.COPY > decontaminate.PARAPHRASE and mixing.LEVELS[0] == "domain"


def test_empty_documents(spark, docs, table):
    sf = table(documents=docs([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert cp.run(spark, sf).count() == 0
