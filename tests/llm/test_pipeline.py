"""The pipeline's stages on odd tables, ids that are null or repeat, and the join's recall near its threshold."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import chat, decontamination, ngram_join, packing, quality_model, quality_rules, token_counts, token_files, tokens

from .test_llm import _docs, _shingles, _texts

WORDS = [a + b for a in ("the", "a", "of", "river", "tree", "house", "walk", "green", "stone", "north") for b in ("", "s", "ly", "ing", "er", "ward")]


def _prose(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


def _corpus(spark, rows, folder, benchmark, labels):
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _plain(docs, benchmark, model, spark):
    """The stages one after another: scores and rules a document at a time, near copies and benchmark words by brute force."""
    good = {r.row for r in quality_model.scored(docs, model).filter("_score >= 0.5").collect()}
    kept = {r.row: (r.doc_id, r.text) for r in quality_rules.cleaned(docs).collect() if r.row in good}
    sets = {k: _shingles(t) for k, (_, t) in kept.items()}
    label = {k: k for k in kept}
    for a in kept:
        for b in kept:
            x, y = sets[a][1], sets[b][1]
            if a < b and x and (sets[a][0] == sets[b][0] or len(x & y) >= 0.8 * len(x | y)):
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    classes = collections.defaultdict(list)
    for k, v in label.items():
        classes[v].append(k)
    first = {min(own, key=lambda k: (kept[k][0] is None, kept[k][0] or 0)) for own in classes.values()}
    windows = set()
    for _, t in benchmark:
        w = _shingles(t)[0]
        windows |= {w[k : k + 13] for k in range(len(w) - min(13, len(w)) + 1)} if w else set()
    out = []
    for k in first:
        w = sets[k][0]
        hit = {j for p in windows for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p for j in range(i, i + len(p))}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(kept[k])
    return out


def test_pipeline_is_its_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    texts = [_prose(rng, int(n)) for n in rng.integers(40, 200, 40)] + ["BUY NOW!! " * int(n) for n in rng.integers(5, 40, 20)]
    near = texts[3].split(" ")
    near[9] = "changed"
    bench = [(1, " ".join(texts[5].split(" ")[:30])), (2, None), (None, texts[7])]
    texts += [" ".join(near), texts[3], texts[8], "", None, " ", "\n".join([texts[9], "Home | About | Contact", "Click here"]), _prose(rng, 6000)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[10], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("x"), "a.b": F.lit(1), "label": F.lit(2)})
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    labels = [(k, int(k < 40), 0) for k in range(60)] + [(0, 1, 0), (None, 0, 0), (3, None, 0)]
    folder = _corpus(spark, docs, tmp_path, bench, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = collections.Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, folder).filter("start = 0").collect())
    own = Tokenizer.from_file(tokens.public("word_bpe_49k.json"))
    want = _plain(docs, bench, quality_model.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), spark)
    assert got == collections.Counter((d, len(own.encode(t, add_special_tokens=False).ids) + 1) for d, t in want)
    assert 20 < sum(got.values()) < len(texts)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs = _docs(spark, _texts(), extra=True)
    folder = _corpus(spark, docs.filter("false"), tmp_path, [], [])
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, folder)
        assert own.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_join_recall_near_the_threshold(spark):
    """All pairs with a similarity from 0.80 to 0.85 are found: at least 99 in 100 of some 400, by brute force."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(400):
        base = list(rng.choice(words, 104))
        other = list(base)
        for at in (20, 70):  # each change touches five of a hundred shingles on both sides
            other[at] = "x"
        texts += [" ".join(base), " ".join(other)]
    sets = [_shingles(t)[1] for t in texts]
    near = [(k, k + 1) for k in range(0, len(texts), 2) if 0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) <= 0.85]
    found = {r.doc_id: r.n_links for r in ngram_join.joined(_docs(spark, texts)).collect()}
    recall = sum(found[a] == found[b] == 1 for a, b in near) / len(near)
    print(f"recall of {len(near)} pairs from 0.80 to 0.85: {recall:.4f}")
    assert len(near) > 300 and recall >= 0.99


ODD = [(None, "a b"), (None, "a b"), (None, None), (5, "c d e"), (5, "c d e"), (5, "other"), (6, "")]


@pytest.mark.parametrize("tie", [1, 3])
def test_null_and_repeated_ids(spark, tie):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(ODD * tie, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("start", F.lit(1))
    for name, run in (("byte_bpe_50k.json", lambda: token_files.encoded(docs, tokens.public("byte_bpe_50k.json"))), ("word_bpe_49k.json", lambda: packing.digest(packing.pack(docs, tokens.public("word_bpe_49k.json"))))):
        own = Tokenizer.from_file(tokens.public(name))
        want = collections.Counter()
        for d, t in ODD * tie:
            ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
            want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        rows = run().collect()
        whole = lambda r: (r.doc_id, r.n_tokens, zlib.crc32(np.array(r.tokens, "<u4").tobytes())) if "tokens" in r else (r.doc_id, r.doc_tokens, r.ids_crc32)
        assert collections.Counter(map(whole, rows)) == want, name
    counted = token_counts.token_counts(docs, tokens.public("piece_bpe_32k.model")).collect()
    assert collections.Counter(r.doc_id for r in counted) == collections.Counter(d for d, _ in ODD * tie)
    judged = quality_rules.judged(docs).collect()
    assert collections.Counter(r.doc_id for r in judged) == collections.Counter(d for d, _ in ODD * tie)
    found = decontamination.hits(docs, spark.createDataFrame([(None, "a b"), (4, "other")], "item_id long, text string")).collect()
    assert sum(len(r.spans) for r in found) == 3 * tie and sum(r["items"] == [4] for r in found) == tie


def test_conversations_with_null_ids_and_ties(spark):
    rows = [(None, 0, "user", "b"), (None, 0, "user", "a"), (None, None, "system", "s"), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, None, None, None)]
    got = {r.conv_id: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 3, 1: 2, 2: 1} and not got[1].ok and got[2].loss_chars == 0
    again = {r.conv_id: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: v.turns_sha256 for k, v in got.items()} == {k: v.turns_sha256 for k, v in again.items()}


def test_conversations_are_read_as_one_text(spark):
    """Rows may end anywhere: the same text cut into other rows gives the same digest; rubbish raises."""
    own = chat.formatted(spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u [INST] </s>"), (1, 2, "assistant", "a\\"), (1, 3, "tool", "<<TURN>>")], "conv_id long, turn long, role string, text string"))
    rows = own.orderBy("turn_no").collect()
    pieces = [x for r in rows for x in r.segments]
    cut = [(1, k, r.ok, r.problem, own_) for k, (r, own_) in enumerate(zip(rows, (pieces[:1], pieces[1:5], pieces[5:6], pieces[6:]), strict=True))]
    again = spark.createDataFrame(cut, own.schema).coalesce(1)
    read = lambda df: [r.asDict() for r in chat.digests(df).drop("problem", "ok").collect()]
    assert read(again) == read(own) and read(own)[0]["n_turns"] == 4
    with pytest.raises(Exception, match="no turn"):
        chat.digests(spark.createDataFrame([*cut[:3], (1, 3, True, None, [("rubbish", False)])], own.schema).coalesce(1)).collect()
