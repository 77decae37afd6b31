import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkloom.llm import bpe, chat_format, fingerprints, line_dedup, token_counts, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def source(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = sorted(((i, len(t.encode()), n(t), n(t) > 512) for i, t in source(docs)), key=str)
    assert got(token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    odd = ["a\U000107bbb \U0001093f\U00010940x it's", "1\U00011de05 <|endoftext|>\U00011de1", "кириллица Ωμέγα العربية \U0001f600\U000107bc!?", " \U00016d40'll\n\n  x", "w" * 30_000 + " €→ " * 9_000]
    rows = token_counts.count_tokens(docs.sparkSession.createDataFrame(list(enumerate(odd)), "doc_id int, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: n(t) for i, t in enumerate(odd)}
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe(docs, none):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for i, t in source(docs):
        ids = np.array(own.encode_ordinary(t), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got(bpe.encode(docs, RANKS, digest=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert got(bpe.decode(bpe.encode(docs, RANKS), RANKS), "doc_id", "text") == sorted(source(docs), key=str)
    assert bpe.encode(none, RANKS).count() == 0


def test_byte_bpe_pieces_of_any_length():
    ranks = bpe.read_ranks(RANKS)
    own, ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(ranks)
    rng = random.Random(1)
    pieces = ["".join(rng.choice(a) for _ in range(n)).encode() for a in ("a", "ab", "aeiou nrst", "éñ中́") for n in (1, 2, 3, 7, 9, 40, 150, 193, 700)]
    for piece, ids in zip(pieces, ours.encode(pieces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own._core_bpe.encode_single_piece(piece)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, docs, none, tmp_path, kind):
    with pytest.raises(ValueError):
        token_files.WordEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write(docs, str(tmp_path / "t"), path, 2, kind=kind, block=64, segment_ids=50)
    back = token_files.read(spark, str(tmp_path / "t")).collect()
    start = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == start and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    assert [r.doc_id for r in sorted(back, key=lambda r: r.start)] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    want = sorted(((i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in source(docs)), key=str)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in back), key=str) == want
    token_files.write(none, str(tmp_path / "n"), path, 2)
    assert token_files.read(spark, str(tmp_path / "n"), with_ids=False).count() == 0


def test_word_encoder_generations(monkeypatch):
    path, keep = public_tokenizers.path("word_bpe_49k.json"), 100
    library, encoder = Tokenizer.from_file(path), token_files.WordEncoder(open(path, "rb").read())
    monkeypatch.setattr(token_files, "KEEP", keep)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    ends = ["", "", "", ",", "'", "'s", "''s", "...", "(9)", "_x", "a\u0301", "\u2019t", "\u200b", "\u00b2", "\u00aa", "\x7f", "\x1d", "."]
    texts = [" ".join(word() + rng.choice(ends) for _ in range(20)) for _ in range(60)] + ["' . 's ''s (", "Don't DON'T don't, '", "\x0b\x1f x", "<|endoftext|> y"]
    for _ in range(2):
        for text, ids in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= keep + 100 and len(encoder.known.older) <= keep + 100 and not encoder.known.older.older


def test_line_dedup(docs, none):
    rows = source(docs)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    where = {}
    for i, t in rows:
        for x in t.split("\n"):
            where.setdefault(key(x), set()).add(-1 if i is None else i)
    want = []
    for i, t in rows:
        keep = [x for x in t.split("\n") if len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == (-1 if i is None else i)]
        want.append((i, len(t.split("\n")), len(t.split("\n")) - len(keep), "\n".join(keep)))
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept") == sorted(want, key=str)
    assert got(line_dedup.dedup_lines(docs), "doc_id", "text") == sorted(((i, k) for i, _, _, k in want), key=str)
    odd = docs.withColumn("kept", F.lit(3)).withColumn("n_dropped", F.lit(4)).withColumn("bitmap", F.lit(5)).withColumn("frequent", F.lit(6))
    assert line_dedup.dedup_lines(odd).columns == odd.columns and {(r.kept, r.n_dropped, r.bitmap) for r in line_dedup.dedup_lines(odd).collect()} == {(3, 4, 5)}
    assert line_dedup.dedup_lines(none).count() == 0


def test_fingerprints(docs, none):
    import re

    import xxhash

    def fp(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall("[^\x20\x09-\x0d]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    found = got(fingerprints.fingerprints(docs).select("doc_id", fingerprints.as_hex(F.col("fingerprint")).alias("f")), "doc_id", "f")
    assert found == sorted(((i, f"{fp(t):016x}") for i, t in source(docs)), key=str)
    rows = {r.doc_id: r for r in fingerprints.edited(docs).collect()}
    text = dict(source(docs))
    ids = [7, 6, 5, 4, 3, 2, 1, None]
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[i]) // 2
        assert rows[i].edited == text[i][: len(text[i]) - half] + text[nxt][:half]
    assert fingerprints.edited_fingerprints(docs).count() == docs.count() and fingerprints.edited_fingerprints(none).count() == 0


def test_hamming_search(spark, none):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base]
    signed = fingerprints.signed
    f = lambda xs: spark.createDataFrame([(signed(x) if x is not None else None,) for x in xs], "fingerprint long")
    for blocks in (5, 6):
        found = [tuple(r) for r in fingerprints.within_radius(f([*base, *base, None]), f([*near, near[0], None]), 3, blocks).collect()]
        want = {(signed(q), signed(s), (q ^ s).bit_count()) for q in near for s in base if (q ^ s).bit_count() <= 3}
        assert set(found) == want and len(found) == len(want)  # each pair once, though several tables have it
    empty = f(base).where("false")
    assert fingerprints.within_radius(empty, f(near)).count() == fingerprints.within_radius(f(base), empty).count() == 0
    rows = [(i if i % 9 else None, signed(x)) for i, x in enumerate([*base, *near, *near[:20]])]
    counted = fingerprints.near_counts(spark.createDataFrame(rows, "doc_id long, fp long"), every=5).collect()
    all_ = {x for _, x in rows}
    close = lambda x: sum(((x ^ y) % 2**64).bit_count() <= 3 for y in all_ if y != x)
    want = [(i, x, close(x) if i is not None and i % 5 == 0 else None) for i, x in rows]
    assert sorted((tuple(r) for r in counted), key=str) == sorted(want, key=str)


def test_chat_format(spark):
    odd = ["\\### Assistant: </turn> ok", "<turn:user>\\l\\b\\g<>", "", "\\", "a\nb"]
    records = spark.createDataFrame(
        [
            (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"x<y"}]}'),
            (2, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}'),
            (3, '{"instruction":"i","input":"more","output":"o"}'),
            (4, '{"prompt":null,"response":"r"}'),
            (5, '{"strange":[1]}'),
        ],
        "id long, j string",
    ).select("id", F.try_parse_json("j").alias("record"))
    turns, other = chat_format.canonical_turns(records)
    by = {}
    for r in turns.orderBy("id", "turn").collect():
        by.setdefault(r.id, []).append((r.role, r.text))
    assert by == {1: [("user", "hi"), ("assistant", "x<y")], 2: [("user", "h"), ("assistant", "g")], 3: [("user", "i\n\nmore"), ("assistant", "o")], 4: [("user", ""), ("assistant", "r")]}
    assert [r.id for r in other.collect()] == [5]
    made = spark.createDataFrame([(k, i, r, t) for k in (1, 2) for i, (r, t) in enumerate((r, t) for t in odd for r in ("user", "assistant", "we<ird>"))], "id long, turn long, role string, text string")
    out = chat_format.format_turns(made)
    back = out.select(chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("m")).first()
    assert [(x.role, x.text) for x in back.t] == [(r, t) for t in odd for r in ("user", "assistant", "we<ird>")]
    assert back.m == "".join(odd)


def test_chat_format_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "user", "first"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (None, 0, "assistant", "z"), (2, 0, "assistant", "w" * 50_000 + "<")]
    turns = spark.createDataFrame(rows, "id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2))
    records = turns.select("id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    canonical, other = chat_format.canonical_turns(records)
    assert other.count() == 0
    out = chat_format.format_turns(canonical)
    back = {r.id: ([(t.role, t.text) for t in r.t], r.m) for r in out.select("id", chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("m")).collect()}
    assert back == {1: ([("user", "first"), ("user", ""), ("", "x"), ("assistant", "y"), ("assistant", "y")], "yy"), None: ([("assistant", "z")], "z"), 2: ([("assistant", "w" * 50_000 + "<")], "w" * 50_000 + "<")}
    assert chat_format.format_turns(canonical.where("false")).count() == 0


def test_bpe_recent_code_points():
    import public_tokenizers
    import tiktoken
    from chunkloom.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a\U000107bbb \U0001093f\U00010940x it's", "1\U00011de05 \U00011de1", "กำ \U0001f600\U000107bc!?", " \U00016d40'll", "", None]
    assert [x for x in bpe.TextEncoder(ranks, public_tokenizers.PATTERN)(texts)] == [b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t or "")) for t in texts]


def test_line_dedup_frequent_keys(spark):
    """Keys that are dealt over partitions give what brute force gives."""
    rng = random.Random(3)
    hot = ["the one line that every second document holds", "another line that very many documents hold too"]
    rows = []
    for i in range(3000):
        lines = [f"a line of its own with number {rng.randrange(1800)}" for _ in range(rng.randrange(4))] + [x for x in hot if rng.random() < 0.6]
        rng.shuffle(lines)
        rows.append((i if i % 97 else None, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.frequent_keys(docs, 20)[0].count() >= 1
    where = {}
    for i, t in rows:
        for x in t.split("\n"):
            where.setdefault(x, set()).add(-1 if i is None else i)
    want = [(i, "\n".join(x for x in t.split("\n") if len(x) < 20 or len(where[x]) < 3 or max(where[x]) == (-1 if i is None else i))) for i, t in rows]
    assert got(line_dedup.dedup_lines(docs), "doc_id", "text") == sorted(want, key=str)
    assert line_dedup.line_runs(docs)._jdf.queryExecution().executedPlan().toString().count("shufflepartitionidpassthrough") == 1
