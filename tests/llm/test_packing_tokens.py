import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import common, packing, tokens

PARTS = [" ", "  ", "\n", " \n", "a", "the", " b", "'s", "1", "22", "!", "\t", "é", "<|endoftext|>", "\x1c", "\u3000x", "\x85"]


def plain(text):
    return tokens.Encoder.cached().tokenizer.encode(text, add_special_tokens=False).ids


def some_text(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


def test_encoder_equals_the_tokenizer():
    rnd, e = random.Random(1), tokens.Encoder()
    texts = [some_text(rnd, rnd.randrange(60)) for _ in range(400)] + ["x" * 3000, ""]
    for got, t in zip(e.many([t.encode() for t in texts]), texts):
        assert np.frombuffer(got, "<u4").tolist() == plain(t)
    assert e.many([None]) == [b""] and all(len(p) <= 64 for p in e.parts)


def test_words_with_marks_and_lines_are_encoded_by_pretokens():
    e = tokens.Encoder()
    texts = ["a" + "".join(f" word{x}" for x in (",", ".", "%%%", ".\nAnd", "", "7", "\n", "\n\nAnd", "'s", "\tx", "\0y", "é,\n漢字、7", "\u0378", "x" * 90 + "!")), "b word, word.\nAnd", "", "c"]
    for t in texts:
        got, size = e.slice(tokens.pa.array([t.encode()]))
        assert got.tolist() == plain(t) and size.tolist() == [len(plain(t))]
    got, size = e.slice(tokens.pa.array([t.encode() for t in texts]), 2)
    assert got.tolist() == [x for t in texts for x in plain(t) + [2]] and size.tolist() == [len(plain(t)) + 1 for t in texts]
    # a word beside marks or before a line feed is not remembered again for each of them
    assert {" word", ",", ".", "%%%", "And"} <= e.parts.keys() and not {" word,", " word.", " word%%%", " word.\nAnd"} & e.parts.keys()


def test_sure_parts_are_the_tokenizers():
    rnd, e = random.Random(8), tokens.Encoder()
    some = ["a", "Word", "é", "漢字", "7", "22", ",", "!?", "、", "\n", "\n\n", " ", "  ", "'", "'s", "\t", "\0", "\u0378", "\x85", "x" * 70, "_-_"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    assert sum(not tokens.ODD.search(t) for t in texts) > 300
    got, size = e.slice(tokens.pa.array([t.encode() for t in texts]))
    want = [plain(t) for t in texts]
    assert size.tolist() == list(map(len, want)) and got.tolist() == [x for w in want for x in w]


def test_a_worker_remembers_for_one_operator_only():
    e = tokens.Encoder.cached()
    e.counts(["a", " b"])
    assert e.parts
    common.shingles(b"one two three", 2)
    assert not e.parts and common._hashes and e.counts([" b"]) == [1]
    tokens.Encoder.cached()
    assert not common._hashes


def test_character_classes_are_the_tokenizers():
    cut = tokens.Encoder.cached().tokenizer.pre_tokenizer.pre_tokenize_str
    for own, others in ((tokens._L, "b5!"), (tokens._D, "7b!"), (tokens._P, "?b5")):
        chars = [chr(c) for c in range(33, 0x10000) if not 0xD800 <= c < 0xE000 and re.fullmatch(f"[{own}]", chr(c))]
        same, *apart = others
        assert len(chars) > 9 and len(cut("".join(chars))) == 1
        assert len(cut("".join(f"{c}{same}{x}" for c in chars for x in apart))) == 2 * 2 * len(chars)


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 20)
    rnd, e = random.Random(2), tokens.Encoder()
    for _ in range(30):
        t = some_text(rnd, 50)
        assert np.frombuffer(e.many([t.encode()])[0], "<u4").tolist() == plain(t) and sum(e.counts([p for p in e.split(t) if p])) == len(plain(t))


def test_edits_equal_whole_encoding():
    rnd, e = random.Random(3), tokens.Encoder.cached()
    for trial in range(150):
        t = some_text(rnd, rnd.randrange(60))
        tree = tokens.EditedCount(e, t)
        tree.CHUNK = rnd.choice([1, 2, 32])
        for _ in range(5):
            a = rnd.randrange(-1, len(t) + 3)
            b, new = a + rnd.randrange(-1, 6), some_text(rnd, rnd.randrange(4))
            tree.edit(a, b, new)
            a = min(max(a, 0), len(t))
            b = min(max(b, a), len(t))
            t = t[:a] + new + t[b:]
            assert tree.text() == t and tree.tokens == len(plain(t)) and tree.leaves == sum(map(len, tree.chunks))


LONGER = ["漢字", "かな", "、", "word", "ward" * 9, "x" * 50, "7" * 20, "!?" * 30, "\n", "\t", "ж" * 40, "'s", "'", " ", "한국", "\u0378", "é" * 33, "\r\n", "=" * 70, " " * 9, "aAbB"]


def test_edits_of_long_pretokens_equal_whole_encoding(monkeypatch):
    rnd, e = random.Random(5), tokens.Encoder.cached()
    for trial in range(200):
        few = rnd.sample(LONGER, rnd.randrange(1, 6))
        t = "".join(rnd.choice(few) for _ in range(rnd.randrange(200)))
        tree = tokens.EditedCount(e, t)
        tree.CHUNK = rnd.choice([1, 2, 32])
        for _ in range(6):
            a = rnd.randrange(-1, len(t) + 3)
            b = a + rnd.choice([0, 0, 1, 2, 3, 40, 400])
            new = "".join(rnd.choice(few + ["", "Z"]) for _ in range(rnd.randrange(3)))
            tree.edit(a, b, new)
            a = min(max(a, 0), len(t))
            b = min(max(b, a), len(t))
            t = t[:a] + new + t[b:]
            assert tree.text() == t and tree.tokens == len(plain(t)) and tree.leaves == sum(map(len, tree.chunks))


def test_a_small_edit_reencodes_little():
    rnd = random.Random(11)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9F00)) for _ in range(25_000))
    letters = "".join(rnd.choice("abcdefghij") for _ in range(25_000))
    for t in (" ".join(f"word{i}" for i in range(5000)), "\n".join(f"word{i}" for i in range(3000)), "\t".join(f"{i}" for i in range(6000)), han, letters, "、".join(han[i : i + 30] for i in range(0, 20_000, 30))):
        for at in (0, 12_000, 20_000, len(t) - 3):
            tree = tokens.EditedCount(tokens.Encoder.cached(), t)
            tree.edit(at, at + 3, "new")
            assert tree.reencoded <= 30 and tree.reread <= 2_000 and tree.tokens == len(plain(tree.text()))
    # a pattern whose phase the edit shifts is another encoding up to its end
    tree = tokens.EditedCount(tokens.Encoder.cached(), "-=" * 13_000)
    tree.edit(13_000, 13_001, "")
    assert tree.reread <= 26_000 * 5 and tree.tokens == len(plain(tree.text()))


def test_edited_counts_query(spark):
    rows = [(1, "some words here"), (2, None), (3, ""), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    e = F.array(F.struct(F.lit(0).alias("a"), F.lit(2).alias("b"), F.lit("New ").alias("c")), F.lit(None).cast("struct<a:bigint,b:bigint,c:string>"), F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(2).alias("b"), F.lit("x").alias("c")))
    got = sorted(((r.doc_id or 0), r.tokens, r.edited_tokens) for r in tokens.edited_counts(df, e).collect())
    assert got == sorted((i or 0, len(plain(t or "")), len(plain("New " + (t or "")[2:]))) for i, t in rows)
    assert tokens.edited_counts(df.limit(0), e).count() == 0 and tokens.edited_counts(df, F.lit(None).cast(tokens.EDIT)).count() == 5


def test_best_fit_against_a_plain_search():
    rnd = random.Random(4)
    for limit in (1, 3, 1000):
        b, open_, n = packing.BestFit(20, limit), {}, 0
        for _ in range(800):
            size = rnd.randrange(1, 21)
            bin_, off = b.put(size)
            fits = [f for f in open_.values() if f >= size]
            if fits:
                assert open_[bin_] == min(fits) and off == 20 - open_[bin_]
                left = open_.pop(bin_) - size
            else:
                assert (bin_, off) == (n, 0)
                n, left = n + 1, 20 - size
            if left:
                if len(open_) == limit:  # the fullest closes
                    least = min(open_.values())
                    gone = [k for k, v in open_.items() if v == least and k not in {x for s in b.stacks for x in s}]
                    del open_[gone[0]]
                open_[bin_] = left
            assert sorted(open_) == sorted(x for s in b.stacks for x in s) and b.open == len(open_)


def test_pieces():
    assert packing.pieces(1024) == [(0, 1024)] and packing.pieces(1025) == [(0, 1), (1, 1024)] and packing.pieces(2048) == [(0, 1024), (1024, 1024)]


def test_packing_round_trip(spark):
    texts = {1: "a b c " * 900, 2: None, 3: "", 4: "hello world", 5: "x y " * 600, 6: "hello world"}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, piece string").repartition(1)
    rows = packing.pack(df, ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in texts.items():
        own = sorted(docs[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == plain(t or "") + [2] and [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 1024
    total = sum(r.length for r in rows)
    assert len(seqs) <= total / 1024 * 1.3 + 1 and packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, keep=["doc_id", "piece"])


def test_sequences_hardly_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.substring("text", 1, 700)))
    for d, rest in ((docs.coalesce(1), packing.REST), (docs.repartition(211), packing.REST), (docs.repartition(50), 200_000)):
        rows = packing.pack(d, rest=rest).collect()
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append(r)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 1024
        pieces = defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append((r.piece, r.start, r.length))
        assert len(pieces) == 2000 and all([(k, sum(x[2] for x in p[:k])) for k in range(len(p))] == [x[:2] for x in sorted(p)] for p in map(sorted, pieces.values()))
        assert len(seqs) <= 1.02 * sum(r.length for r in rows) / 1024 + 1
