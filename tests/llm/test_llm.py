"""The pipeline operators against brute force, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, common, components, decontamination, kernel, licenses, lm_score, ngram_join, packing, quality_model, quality_rules, token_counts, token_files, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, SOLID = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, extra=False):
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    return rows.withColumns({"score": F.lit("s"), "a.b": F.lit(1), "row": F.lit(2), "c0": F.lit(3), "kept": F.lit(True)}) if extra else rows


def _texts():
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ta", "ré", "Mo", "xi", "ßu", "ka") for b in ("n", "lo", "rst", "ve", "'s", "9", "…")]
    prose = [" ".join(rng.choice(words, n)) + "." for n in (3, 8, 30, 60, 200, 400)]
    near = prose[4].split(" ")
    near[17] = "changed"
    return [*prose, prose[2], prose[2].upper(), " ".join(near), "", None, " ", "\n\n", "a", "x" * 50_000, "é \n\tb  c\r\n d", "</s> [INST] <|endoftext|> <|startoftext|>", " ".join(["word"] * 3000), "  nbsp　wide \x1c ctl", prose[5] + "\n" + prose[1]]


EMPTY = pytest.mark.parametrize("run", [
    lambda s, d: ngram_join.joined(d), lambda s, d: ngram_join.deduplicated(d), lambda s, d: licenses.scanned(d), lambda s, d: token_files.encoded(d, tokens.public("byte_bpe_50k.json")),
    lambda s, d: token_counts.token_counts(d, tokens.public("piece_bpe_32k.model")), lambda s, d: packing.digest(packing.pack(d, tokens.public("word_bpe_49k.json"))), lambda s, d: quality_rules.judged(d), lambda s, d: quality_rules.cleaned(d),
    lambda s, d: decontamination.hits(d, s.createDataFrame([], "item_id long, text string")), lambda s, d: quality_model.accepted(d, s.createDataFrame([], "doc_id long, quality int")), lambda s, d: lm_score.scored(d, lm_score.train(d)),
])


@EMPTY
def test_empty_table(spark, run):
    assert run(spark, _docs(spark, []).filter("false")).count() == 0


def test_empty_conversations(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    texts = _texts()
    out = common.new_path(spark, "test")
    token_files.write_tokens(_docs(spark, texts, extra=True), out, tokens.public("byte_bpe_50k.json"))
    own = Tokenizer.from_file(tokens.public("byte_bpe_50k.json"))
    want = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    got = {r.doc_id: r.tokens for r in token_files.read_tokens(spark, out).collect()}
    assert [got[k] for k in range(len(texts))] == want
    starts = {r.doc_id: r.start for r in token_files.read_metadata(spark, out).collect()}
    assert [starts[k] for k in range(len(texts))] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    assert [r.doc_id for r in token_files.read_tokens(spark, out, [3, 5]).orderBy("doc_id").collect()] == [3, 5]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    signs = ["a", "B", "é", "ß", "1", "२", " ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "'", "!!", "|", "<|endoftext|>", "\xa0", "\x1c", "\x85", "你", "́", "word", "Σ", "'ll", "#", "’", " ", "_", "²"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Tokenizer.from_file(tokens.public(name))
        assert tokens.CachedEncoder(tokens.public(name), limit=500).encode_texts(texts) == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark):
    import sentencepiece

    texts = [*_texts(), "  two  spaces ", "▁mark ▁▁x", "trailing\n", "\n", "a\nb"]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.public("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(_docs(spark, texts, extra=True), tokens.public("piece_bpe_32k.model"), head=20).collect()}
    assert got == {k: (len((t or "").encode()), len(sp.encode(t or ""))) for k, t in enumerate(texts)}


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = _texts() * 3
    rows = packing.pack(_docs(spark, texts, extra=True), tokens.public("word_bpe_49k.json"), size=256, n_open=3).collect()
    own = Tokenizer.from_file(tokens.public("word_bpe_49k.json"))
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, list(r.ids), r.doc_tokens))
        by_window[r.sequence_id].append((r.offset, r.length, r.used))
    for k, t in enumerate(texts):
        want = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for _, ids, _ in sorted(by_doc[k]) for x in ids] == want and {n for *_, n in by_doc[k]} == {len(want)}
    for pieces in by_window.values():
        ends = np.cumsum([n for _, n, _ in sorted(pieces)]).tolist()
        assert [o for o, *_ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] == pieces[0][2] <= 256
    assert sum(r.length for r in rows) / (256 * len(by_window)) > 0.9


def _shingles(t):
    q = tuple(WORD.findall((t or "").translate(LOW)))
    return q, frozenset(q[k : k + 5] for k in range(max(1, len(q) - 4))) if q else frozenset()


def test_ngram_join(spark):
    texts = _texts()
    base = texts[5].split(" ")
    for k in range(40):  # a group of near copies, some of them copies
        own = list(base)
        own[7 * (k % 25) + 3] = f"z{k % 25}"
        texts.append(" ".join(own))
    sets = [_shingles(t) for t in texts]
    link = lambda a, b: sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if link(a, b):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min(k for k in range(len(texts)) if label[k] == x) for x in set(label)}
    for block in (4, 512):
        ngram_join.BLOCK, ngram_join.BUCKET_BLOCK = block, block
        got = {r.doc_id: r for r in ngram_join.joined(_docs(spark, texts, extra=True)).collect()}
        for k, (q, _) in enumerate(sets):
            assert got[k].class_id == least[label[k]]
            assert got[k].n_links == len({sets[j][0] for j in range(len(texts)) if sets[j][0] != q and link(k, j)})
            assert got[k].n_copies == (sum(s[0] == q for s in sets) if q else 1)
    kept = {r.doc_id for r in ngram_join.deduplicated(_docs(spark, texts)).collect()}
    assert kept == set(least.values())


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (103, 103)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_decontamination(spark):
    docs = _texts()
    items = [(1, docs[4]), (2, "a"), (3, None), (4, ""), (5, " ".join(docs[5].split(" ")[50:80])), (None, docs[3]), (1, docs[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(len(w) - min(13, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + 13])].add(i)
    for block in (1 << 25, 600):
        got = {r.doc_id: r for r in decontamination.hits(_docs(spark, docs, extra=True), bench, block_bytes=block).collect()}
        for d, t in enumerate(docs):
            w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
            for p, own in windows.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        found |= own
            assert got[d].n_words == len(w) and sum(s.words for s in got[d].spans) == len(hit) and got[d].items == sorted(found - {None}), (block, d)
    left = {r.doc_id for r in decontamination.decontaminated(_docs(spark, docs, extra=True), bench).collect()}
    assert 4 not in left and 0 in left


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\ [INST] </s>"), (1, 1, "assistant", "<s>\\</s>\\\\"), (2, 0, "assistant", None), (2, 0, None, "x<<TURN>>"), (2, 1, "tool", ""), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a["), (3, 3, "user", "b")]
    got = {r.conv_id: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c, own in ((1, rows[:2]), (3, rows[5:])):
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest() and got[c].ok
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in own if r == "assistant").encode()).hexdigest()
    assert got[2].n_turns == 3 and not got[2].ok
    t = chat.Template()
    for x in ("\\", "[\\INST]", "[INST]", "<\\s>", "</s></s>", "<<TURN>><<SAYS>>"):
        assert t.unescape(t.escape(x)) == x and not any(c in t.escape(x) for c in t.controls)


def test_quality_rules(spark):
    texts = [*_texts(), "Home | About | Contact\n" + " ".join(f"word{k}," for k in range(40)) + ".\nClick here\nClick here", "ALL CAPS WORDS " * 20]
    got = {r.doc_id: r for r in quality_rules.judged(_docs(spark, texts, extra=True)).collect()}
    for k, t in enumerate(texts):
        w = SOLID.findall(t or "")
        grams = collections.defaultdict(list)
        for i in range(len(w) - 7):
            grams[tuple(w[i : i + 8])].append(i)
        again = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if SOLID.search(x)]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert got[k].base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (got[k].kept and got[k].base_failed)
    n = len(texts) - 2
    assert got[n].kept and not got[n + 1].kept
    clean = {r.doc_id: r for r in quality_rules.cleaned(_docs(spark, texts, extra=True)).collect()}
    assert clean[n].text == texts[n].split("\n")[1] and clean[n].n_chars == len(clean[n].text) and clean[n]["a.b"] == 1


def test_quality_model(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    good = [" ".join(rng.choice(words, 40)) + "." for _ in range(120)]
    bad = ["BUY NOW!! " * int(n) for n in rng.integers(5, 30, 120)]
    docs = _docs(spark, [*good, *bad, "", None], extra=True)
    labels = spark.createDataFrame([(k, int(k < 120)) for k in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.scored(docs, quality_model.fit(docs, labels)).withColumnRenamed("_score", "own").drop("score").withColumnRenamed("own", "score").collect()
    held = [r for r in got if r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 40 and all((r.score >= 0.5) == (r.doc_id < 120) for r in held) and all(0 <= r.score <= 1 for r in got)


def test_deduplicated_keeps_one_row_where_ids_tie(spark):
    """Near copies without ids, or of one id, are one class with one row left; rows without words all stay."""
    words = [f"w{k}" for k in range(300)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (20, 150, 299)]
    other = " ".join(f"v{k}" for k in range(300))
    rows = [(None, near[0]), (None, near[1]), (None, near[2]), (None, other), (7, "z " + other), (7, other + " z"), (9, other), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows[:3] + rows[7:], "doc_id long, text string")
    got = [r.text for r in ngram_join.deduplicated(docs).collect()]
    assert len(got) == 3 and sum(t in near for t in got) == 1
    docs = spark.createDataFrame(rows[3:7], "doc_id long, text string")
    got = ngram_join.deduplicated(docs).collect()
    assert len(got) == 1 and got[0].doc_id == 7


def test_decontaminated_judges_by_all_passes(spark):
    """A document with 4 % of its words from each of two passes' items goes, and texts are cut once, as in one pass."""
    first, second = ([f"{x}{k}" for k in range(13)] for x in "pq")
    filler = [f"w{k}" for k in range(300)]
    texts = [" ".join(filler[:100] + first + filler[100:] + second), " ".join([*filler, *first]), " ".join([*filler[:50], *first, *second, *filler[50:100]]), "clean text", "", None]
    texts.append(texts[0])
    docs = _docs(spark, texts, extra=True)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([first, second, *([f"u{j}x{k}" for k in range(13)] for j in range(6))])], "item_id long, text string")
    parts = [{r.item_id for r in b.collect()} for b in decontamination.parts(bench, 60)]
    assert not any({0, 1} <= p for p in parts)
    for cut in (False, True):
        one, many = (decontamination.decontaminated(docs, bench, cut=cut, block_bytes=b) for b in (1 << 20, 60))
        assert many.columns == docs.columns and many.schema == one.schema
        got = sorted((r.doc_id, r.text) for r in many.select("doc_id", "text").collect())
        assert got == sorted((r.doc_id, r.text) for r in one.select("doc_id", "text").collect())
        assert [k for k, _ in got] == ([0, 1, 2, 3, 4, 5, 6] if cut else [1, 3, 4, 5]) and (not cut or got[2][1] == " ".join(filler[:50]) + "  " + " ".join(filler[50:100]))
    spans = [{r.doc_id: (r.spans, r.items) for r in decontamination.hits(docs, bench, block_bytes=b).collect()} for b in (1 << 20, 60)]
    assert spans[0] == spans[1]


def test_hits_of_inputs_in_any_order(spark):
    """Several blocks give the spans of one, wherever the rows are dealt."""
    texts = [t for t in _texts() if len(t or "") < 3000]
    docs = _docs(spark, texts * 3, extra=True)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(50, "a b"), (None, "c d e")], "item_id long, text string")
    small = sum(len((t or "").encode()) for t in texts) // 4
    seen = lambda d, b: sorted(str((r.doc_id, r.n_words, r.spans, r.items)) for r in decontamination.hits(d, bench, block_bytes=b).collect())
    want = seen(docs, 1 << 25)
    assert len(decontamination.parts(bench, small)) >= 4 and any("Row(" in x for x in want)
    for dealt in (docs.repartition(5), docs.orderBy(F.rand()), docs.repartition(3).filter("doc_id >= 0"), docs.repartition(7, "doc_id")):
        assert seen(dealt, small) == want
    kept = [sorted(r.doc_id for r in decontamination.decontaminated(docs.repartition(5), bench, block_bytes=b).collect()) for b in (1 << 25, small)]
    assert kept[0] == kept[1]


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def test_licenses(spark):
    texts = ["This work is licensed under the Foo Bar License.", "He got a license to fish.", "x.\nReleased under the MIT License.\ny", None, "", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", GPL, "SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: Apache-2.0\nimport os",
             "The driver must renew the license before the contract ends.", "MIT License", "BSD License\n\nCopyright", "The bartender needs a liquor license.", "license", " ".join(["word"] * 100_000), "Licensed under the MIT License. " + "word " * 50_000, "Released under the MIT License."]
    got = {r.doc_id: r for r in licenses.scanned(_docs(spark, texts, extra=True)).collect()}
    assert [got[k].families for k in range(len(texts))] == ["", "", "mit", "", "", "cc_by_nc", "gpl", "mit", "apache", "", "mit", "bsd", "", "", "", "mit", "mit"] and got[0].n_unknown == 1 and got[5].n_confirmed == 2
    assert [got[k].n_licensed for k in (6, 7, 9, 10, 12, 13, 14)] == [1, 1, 0, 1, 0, 0, 0]
    rows = spark.createDataFrame([(None, texts[2]), (None, texts[2]), (7, texts[2]), (7, texts[2])], "doc_id long, text string")
    assert [r.families for r in licenses.scanned(rows).collect()] == ["mit"] * 4


def test_quality_model_votes_as_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 60, 160)] + ["", None, "w1 " * 30_000]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(160)] * 2, "doc_id long, quality int")
    twice = docs.unionByName(docs.limit(40)).unionByName(docs.limit(9).withColumn("text", F.lit("other text of a labelled id")))
    model = quality_model.fit(twice, labels)
    assert len(model.labels) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(160))
    got = {r.doc_id: r.score for r in quality_model.scored(docs, model).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        _, term, weight = quality_model.terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        dense = np.zeros(quality_model.TERMS)
        dense[term] = quality_model._weighted(np.zeros(len(term), np.int64), term, weight, 1, model.idf)
        own = dense @ model.projection
        cosines = model.vectors @ own / max(np.linalg.norm(own), 1e-9)
        near = sorted(range(len(cosines)), key=lambda j: (-round(float(cosines[j]), 5), j))[: quality_model.NEIGHBOURS]
        vote = np.maximum(cosines[near], 0) ** quality_model.POWER + 1e-6
        assert got[k] == pytest.approx(float((vote * model.labels[near]).sum() / vote.sum()) if raw else model.prior, abs=0.02)
    assert quality_model.nearest(np.array([[1.0, 3, 2, 2, 2]]), 2).tolist()[0] in ([1, 2], [2, 1])


def test_windows_are_those_of_the_items(spark):
    import pyarrow as pa

    texts = [" ".join(f"w{k % 9}" for k in range(40)), "a b", None, "", "a b", "w1 " * 13]
    w = decontamination.Windows([5, 6, 7, 8, 9, 10], pa.array(texts, pa.large_string()), 13)
    want = collections.defaultdict(set)
    for k, t in enumerate(texts):
        own = (t or "").split()
        for i in range(len(own) - min(13, len(own)) + 1) if own else ():
            want[tuple(own[i : i + 13])].add(k)
    names = {int(h): t for t, h in ((t, kernel.text_hashes([t])[0][0]) for t in {x for t in texts for x in (t or "").split()})}
    got = {}
    for k, (last, size) in enumerate(zip(w.last, w.sizes, strict=True)):
        got[tuple(names[int(w.vocabulary[c - 1])] for c in w.symbols[last - size + 1 : last + 1])] = set(w.item_of[w.first[k] : w.first[k + 1]].tolist())
    assert got == want


def test_windows_take_bounded_memory():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 10**9, 100_000)))
    w = decontamination.Windows([0], pa.array([text], pa.large_string()), 13)
    assert w.table_bytes < 27 * 100_000
