"""Every operator against a plain version, on documents with all kinds of odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from symcorpus.llm import chat, components, encoders, entries, media, mixing, packing, pfor, quality, sentences, shared, simhash, substrings, suffixes, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, part string"


def prose(rng, n, vocabulary=4000):
    words = []
    for _ in range(n):
        w = "".join(rng.choice(["an", "er", "é", "th", "oß", "in", "re", "st"]) for _ in range(rng.randint(1, 6)))
        words.append(w + rng.choice(["", "", "", "", ".", ",", ".\n"]))
    return " ".join(words)


def odd_texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 12, 60, 200, 700, 700)]
    passage = prose(rng, 120)
    shared = [prose(rng, 80) + " " + passage + " " + prose(rng, 90) for _ in range(4)]
    near = [base[4].replace(" an ", " the ", 1), base[4] + " more", " ".join(base[5].split(" ")[:-1])]
    return [
        None, "", " ", "\n\t ", "a", "AB ab\x0bab", "naïve ½ × 日本語 <|endoftext|> <s> ▁", "don't   I'll\r\n", "x" * 1500, "ab" * 900, "ß" * 500,
        "one two three. " * 60, "same line here\nsame line here\nother " * 9, *base, *base[2:4], *shared, *near, passage, prose(rng, 9000), "#$% " * 40,
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "clash", "p") for i, t in enumerate(odd_texts())]
    out += [out[15], out[15], (None, "no id here at all but some words " * 4, None, None, None, None, None), (None, None, None, None, None, None, None)]
    out.append((20, "another text of a repeated id", "en", "s1", 5, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_media_round_trip(docs, rows, empty):
    stored = media.texts_to_media(docs)
    got = collected(media.media_digest(stored), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = media.payload_of(raw)
        assert len(p) % 576 == 0 and p
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert got == want
    frames = {r["doc_id"]: r["frames"] for r in media.media_frames(stored.filter("doc_id = 8")).collect()}[8]
    assert b"".join(bytes(f["samples"]) for f in frames)[:1500] == b"x" * 1500 and sum(frames[0]["histogram"]) == 3 * 576 * 3
    assert media.media_digest(media.texts_to_media(empty)).count() == 0 == media.media_frames(media.texts_to_media(empty)).count()


def _gif(frames, size=(4, 3)):
    palette = bytes(v for g in range(256) for v in (g, 255 - g, 7))
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + b"\xf7\0\0" + palette
    for box, disposal, clear, delay, samples in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0]) + b"\0"
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in box) + b"\0\x08"
        stream = media.lzw_encode(samples)
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_gif_disposal_and_transparency():
    full, small = bytes(range(1, 13)), bytes([50, 9, 9, 60])
    data = _gif([((0, 0, 4, 3), 1, None, 5, full), ((1, 1, 2, 2), 3, 9, 7, small), ((0, 0, 1, 1), 2, None, 1, b"\x63"), ((3, 2, 1, 1), 0, None, 2, b"\x58")])
    shown = [(f.delay_cs, f.canvas[..., 0].copy(), f.canvas[..., 3].copy()) for f in media.decode_gif(data)]
    first = np.arange(1, 13).reshape(3, 4)
    second = first.copy()
    second[1, 1], second[2, 2] = 50, 60
    third = first.copy()
    third[0, 0] = 99
    assert [s[0] for s in shown] == [5, 7, 1, 2]
    assert (shown[0][1] == first).all() and (shown[1][1] == second).all() and (shown[2][1] == third).all()
    assert shown[3][2][0, 0] == 0 and shown[3][1][2, 3] == 88


def test_gif_interlace_and_local_palette():
    samples = bytes(range(10, 10 + 2 * 9))  # rows 0 to 8 of width 2
    rows = np.frombuffer(samples, np.uint8).reshape(9, 2)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    stream = media.lzw_encode(rows[order].tobytes())
    local = bytes(v for g in range(256) for v in (7, g, 255 - g))
    box = b"".join(v.to_bytes(2, "little") for v in (0, 0, 2, 9))
    data = b"GIF89a\x02\0\x09\0\0\0\0" + b"\x2c" + box + bytes([0x40 | 0x87]) + local + b"\x08" + bytes([len(stream)]) + stream + b"\0\x3b"
    (frame,) = media.decode_gif(data)
    assert (frame.samples == rows).all() and (frame.canvas[..., 1] == rows).all() and (frame.canvas[..., 0] == 7).all() and (frame.canvas[..., 2] == 255 - rows).all()


def test_broken_and_missing_media_have_rows(spark):
    rng = random.Random(2)
    good = media.encode_gif(media.payload_of(bytes(rng.choice(b"abcdefghijkl ") for _ in range(90_000))))
    no_palette = good[:10] + bytes([good[10] & 0x7F]) + good[11:13] + good[13 + 768 :]
    huge = b"GIF89a\xff\xff\xff\xff" + good[10:]
    kinds = [None, b"", b"GIF", good[:900], good[: len(good) // 2], good[:-1], good[:-40] + bytes(40), b"\0" * 50, no_palette, huge, good]
    docs = spark.createDataFrame([(i, m, "other") for i, m in enumerate(kinds)] + [(10, good, "other")], "doc_id long, media binary, frames string")
    got = media.media_digest(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(11), 10]
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fault"] is None and by[0]["payload_sha256"] is None and by[0]["feature"].startswith("0 frames, 0 cs")
    assert all(by[k]["fault"] for k in range(1, 10)) and by[10]["fault"] is None
    assert by[3]["payload_bytes"] == 0 < by[4]["payload_bytes"] < by[10]["payload_bytes"] == by[5]["payload_bytes"]
    assert by[10]["media_sha256"] == hashlib.sha256(good).hexdigest() and by[10]["media_bytes"] == len(good)


def test_equal_texts_have_equal_values(spark):
    texts = ["alpha beta", "alpha beta", "alpha bet", "x" * 80_000, "x" * 80_000]
    got = media.media_digest(media.texts_to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))).collect()
    rows = [tuple(r[c] for c in r.asDict() if c != "doc_id") for r in sorted(got, key=lambda r: r["doc_id"])]
    assert rows[0] == rows[1] != rows[2] and rows[3] == rows[4]
    want = [np.histogram(np.frombuffer(media.payload_of(t.encode()), np.uint8), 8, (0, 256))[0].tolist() * 3 for t in texts]
    assert rows[0][list(got[0].asDict()).index("feature") - 1] == "1 frames, 4 cs, histogram " + " ".join(map(str, want[0]))


def test_lzw_full_table_and_small_codes():
    rng = random.Random(1)
    for data in (b"a", b"ab" * 40_000, bytes(rng.randrange(256) for _ in range(30_000)), bytes(rng.choice(b"abc") for _ in range(90_000))):
        assert media.lzw_decode(media.lzw_encode(data), 8, len(data)) == data
    # code size 2: clear, 1, the entry being made, stop
    bits = sum(v << s for v, s in ((4, 0), (1, 3), (6, 6), (5, 9)))
    assert media.lzw_decode(bits.to_bytes(2, "little"), 2, 3) == b"\1\1\1"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """(id, fingerprint) pairs as the least id of each pair's component."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for _, f in pairs]


def test_simhash(docs, rows, empty):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = Counter((i, f, c) for (i, f), c in zip(pairs, plain_components(pairs), strict=True))
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({simhash_root for simhash_root in plain_roots(pairs)}) and kept[0].asDict().keys() == set(docs.columns)
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def plain_roots(pairs):
    fake = [(k, f) for k, (_, f) in enumerate(pairs)]
    return plain_components(fake)


def plain_wide_roots(texts):
    """Groups of texts that are equal, or share a band and differ in WIDE["radius"] bits or fewer."""
    made = []
    for t in texts:
        words = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))] if words else []
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        mixed = lambda x, k: ((x ^ int(simhash._SALTS[k])) * int(simhash._FACTORS[k])) % (1 << 64)
        least = [min((v ^ v >> 29 for v in (mixed(x, k) for x in h)), default=None) for k in range(simhash.WIDE["bands"] * simhash.BAND_ROWS)]
        made.append((fp, [tuple(least[k : k + simhash.BAND_ROWS]) for k in range(0, len(least), simhash.BAND_ROWS)] if h else []))
    root = list(range(len(texts)))
    for i, (a, x) in enumerate(made):
        for j, (b, y) in enumerate(made[:i]):
            if a == b or (a ^ b).bit_count() <= simhash.WIDE["radius"] and any(p == q for p, q in zip(x, y, strict=False)):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_wide_links_find_similar_texts(spark):
    rng = random.Random(12)
    rows = []
    for i in range(30):
        told = words(rng, 300).split()
        rows.append((10 * i, " ".join(told)))
        for k in range(1, 4):  # up to six of 300 words replaced: a similarity of 0.8 or more
            other = list(told)
            for at in rng.sample(range(300), 2 * k):
                other[at] = "zz"
            rows.append((10 * i + k, " ".join(other)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.WIDE).collect()}
    assert all(got[i] // 10 == i // 10 for i in got) and sum(got[i] == i // 10 * 10 for i in got) >= 0.95 * len(got)


def test_hot_keys_change_nothing(spark):
    """With every key heavy and with none the results are the same."""
    rng = random.Random(8)
    base = [words(rng, 40) + ". " + words(rng, 40) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 3 else base[i % 12] + " " + words(rng, i % 5 + 1)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = []
    before = shared.LEAST_ROWS, sentences.OFTEN, simhash.TILE
    try:
        for shared.LEAST_ROWS, sentences.OFTEN, simhash.TILE in ((0, 2, 64), (1 << 40, 1 << 40, 8192)):
            near = collected(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
            wide = collected(simhash.near_duplicates(docs, **simhash.WIDE), "doc_id", "fp", "component_id")
            out.append((near, wide, collected(sentences.drop_repeated_spans(docs), "doc_id", "n_removed", "kept"), collected(substrings.dedup_report(docs), *REPORT)))
    finally:
        shared.LEAST_ROWS, sentences.OFTEN, simhash.TILE = before
    assert out[0] == out[1]
    roots = plain_wide_roots([t for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    assert {(i, c) for i, _, c in out[0][1]} == {(i, least[r]) for (i, _), r in zip(rows, roots, strict=True)}


def test_bit_sliced_links_are_exact(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for n in range(1, 8):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    for parts, tile in ((5, 8192), (6, 8192), (7, 8192), (5, 3)):
        simhash.TILE, before = tile, simhash.TILE
        try:
            nodes = {r["node"]: r["root"] for r in components.components(simhash.near_links(frame, 4, parts)).collect()}
        finally:
            simhash.TILE = before
        got = defaultdict(set)
        for f in signed:
            got[nodes.get(f, f)].add(f & (1 << 64) - 1)
        want = defaultdict(set)
        for f, c in zip(fps, plain_components(list(enumerate(fps))), strict=True):
            want[c].add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.components(edges.filter("u < 0")).count() == 0


def plain_measures(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality(docs, rows, empty):
    judged = quality.quality(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(judged, "doc_id", *names) == Counter((r[0], *plain_measures(r[1])) for r in rows)
    assert judged.filter("kept AND base_failed").count() == 0 and quality.quality(empty).count() == 0
    assert judged.filter("doc_id = 17 AND kept").count() == judged.filter("doc_id = 17").count()


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += plain_measures(r[1])[0]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    free, share = set(sizes), {}
    left = sum(sizes.values())
    while True:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if per * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            share[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= full
    share |= {s: per * weight[s] for s in free}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - share[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(rows) and all(abs(taken[s] - share[s]) <= largest[s] for s in share)
    again = collected(mixing.mix(docs.repartition(3)), "doc_id", "size", "taken")
    assert again == collected(mixing.mix(docs), "doc_id", "size", "taken")
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_ties_of_a_mix_are_settled_alike(spark):
    texts = ["b b b", "a a a", "c c c", "a a a", "d d", None, ""]
    rows = [(1 + k // 4, t, s, "clash", 0, 0) for k, t in enumerate(texts * 3) for s in ("s", "t", None)] + [(None, "n n n", "s", "x", 1, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, n long, k long")
    out = [collected(mixing.mixed(docs.repartition(n)), *docs.columns) for n in (1, 3, 7)]
    assert out[0] == out[1] == out[2] and sum(out[0].values()) == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_many_sources_share_what_small_ones_cannot_take(spark):
    rows = [(i, f"s{i % 40:02d}", 1 + (i % 40) ** 3 // 50) for i in range(4000)]
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    by = {r["source"]: (r["source_size"], r["target"], r["taken"]) for r in got.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert abs(sum(t for _, t, _ in by.values()) - sum(r[2] for r in rows)) < 1e-3
    assert any(t == 3 * s for s, t, _ in by.values()) and all(t <= 3 * s and abs(n - t) < 0.02 * t + 2000 for s, t, n in by.values())


def test_token_counts(docs, rows, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows)
    assert collected(token_counts.token_counts(docs, model), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, model).count() == 0


@pytest.mark.parametrize(("name", "make"), [("byte_bpe_50k.json", encoders.byte_encoder), ("word_bpe_49k.json", encoders.word_encoder)])
def test_encoders_equal_the_library(name, make):
    path = public_tokenizers.path(name)
    library, texts = Tokenizer.from_file(path), [*odd_texts(), "A\x85b\xa0c\x1cd", "ÀÉ ǅ İ ﬁ", "l'été aujourd'hui  \n  x", "'s't", "a\n\n b"]
    assert make(path).encode(texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_chat(spark):
    conversations = spark.createDataFrame(
        [(1, 0, "user", "hi <|im_end|> \\ <\\| \n"), (1, 1, "assistant", "<|nl|> ok\\"), (1, 1, "assistant", "twice"), (2, 0, None, None), (None, 0, "sys\ntem<|", "x")],
        "conv_id long, turn long, role string, text string",
    )
    done = chat.read_back(chat.render(chat.fold(chat.messages_as_events(conversations)))).collect()
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in done}
    assert got == {
        1: ([("user", "hi <|im_end|> \\ <\\| \n"), ("assistant", "<|nl|> ok\\"), ("assistant", "twice")], "<|nl|> ok\\twice"),
        2: ([("", "")], ""),
        None: ([("sys\ntem<|", "x")], ""),
    }
    assert chat.render(chat.fold(chat.messages_as_events(conversations.limit(0)))).count() == 0


def test_chat_events(spark):
    log = [
        (1, 0, 0, "message", "user", "q"),
        (1, 1, 1, "message", "assistant", "a"), (1, 1, 2, "delta", "assistant", "b"), (1, 1, 3, "regenerate", "assistant", "c"), (1, 1, 4, "delta", "assistant", "d"),
        (1, 0, 9, "edit", "user", "Q"),
        (1, 2, 10, "delta", "assistant", "e"), (1, 2, 11, "delta", "assistant", "f"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = [(r["role"], r["text"]) for r in chat.fold(events).orderBy("place").collect()]
    assert got == [("user", "Q"), ("assistant", "cd"), ("assistant", "ef")]
    row = chat.render(chat.fold(events)).first()
    assert [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss"]] == ["cd", "ef"]


def test_file_format():
    rng = np.random.default_rng(2)
    cases = [rng.integers(0, 2**32, 3000), rng.integers(0, 2, 1500), np.where(rng.random(4000) < 0.03, 2**31, rng.integers(40, 60, 4000)), np.full(1025, 7), np.zeros(0), np.array([2**32 - 1])]
    for ids in cases:
        ids = ids.astype(np.uint32)
        data = pfor.encode_blocks(ids)
        assert (pfor.decode_blocks(data) == ids).all() and (pfor.decode_blocks(data, 1, 3) == ids[512:1536]).all()
    assert len(pfor.encode_blocks(cases[2].astype(np.uint32))) < 4000 * 1.3


def test_token_files(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, Counter()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[(r[0], start, len(ids), zlib.crc32(ids))] += 1
        start += len(ids)
    before, pfor.FILE_IDS = pfor.FILE_IDS, 1000
    try:
        got = collected(pfor.read_files(pfor.write_files(docs, path, 2)), "doc_id", "start", "n_tokens", "ids_crc32")
    finally:
        pfor.FILE_IDS = before
    assert got == want and pfor.read_files(pfor.write_files(empty, path, 2)).count() == 0


def plain_cut(texts, span):
    """Bytes of each text that no repeated string of span bytes covers, and the removed runs."""
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i + 1 : i + span + 1] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((int(gone.sum()), runs, bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)))
    return out


def plain_report(rows, span):
    cut = plain_cut([(r[1] or "").encode() for r in rows], span)
    return Counter((r[0], len((r[1] or "").encode()), n, k, hashlib.sha256(b).hexdigest()) for r, (n, k, b) in zip(rows, cut, strict=True))


REPORT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup(docs, rows, empty):
    assert collected(substrings.dedup_report(docs), *REPORT) == plain_report(rows, 400)
    assert substrings.dedup_report(empty).count() == 0 and substrings.without_repeats(docs).columns == docs.columns


def test_block_of_suffixes():
    rng = random.Random(4)
    for letters, levels in ((b"ab", (32, 100)), (b"a", (40,)), (b"abcdefgh ", (47, 256, 400)), (bytes(range(256)), (33, 64))):
        pool = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(6)]
        texts = [b"".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(12)]
        starts, room = np.array([(sum(map(len, texts[:k])) + i, len(t) - i) for k, t in enumerate(texts) for i in range(len(t))]).T
        found = suffixes.repeated(b"".join(texts), starts, room, levels)
        for level, flags in zip(levels, found, strict=True):
            seen = Counter(t[i : i + level] for t in texts for i in range(len(t) - level + 1))
            assert flags.tolist() == [len(t) - i >= level and seen[t[i : i + level]] > 1 for t in texts for i in range(len(t))]


def test_the_shift_puts_both_into_the_cover():
    for a in range(16):
        for b in range(16):
            assert {(a + suffixes.SHIFT[a, b]) % 16, (b + suffixes.SHIFT[a, b]) % 16} <= set(suffixes.COVER)


def edited(seed, n=150):
    rng = random.Random(seed)
    pool = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(30, 900))).decode() for _ in range(25)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))
        cut = rng.randrange(len(text))
        rows.append((i, text[:cut] + rng.choice(["", "#", "zz"]) + text[cut + rng.choice([0, 1, 60]) :]))
    return rows


@pytest.mark.parametrize("large", [8192, 3, 0])
def test_two_lengths_and_buckets_of_any_size(spark, large):
    rows = [*edited(11, 100), *[(200 + i, "hot " * 150 + str(i)) for i in range(9)], (300, "x" * 2000), (301, "y" * 330), (301, "y" * 330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before, substrings.LARGE = substrings.LARGE, large
    try:
        got = collected(substrings.dedup_report(docs, short=256), *REPORT, "n_repeated")
    finally:
        substrings.LARGE = before
    by_short = [c[0] for c in plain_cut([t.encode() for _, t in rows], 256)]
    cut = plain_cut([t.encode() for _, t in rows], 400)
    want = Counter((i, len(t), n, k, hashlib.sha256(b).hexdigest(), m) for (i, t), (n, k, b), m in zip(rows, cut, by_short, strict=True))
    assert got == want


def test_texts_that_a_polynomial_hash_takes_for_equal(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo a power of two."""
    word = [bin(i).count("1") % 2 for i in range(128)]
    rng = random.Random(1)
    rows = []
    for k in range(40):
        head = "".join(rng.choice("abcdefghijklmnop ") for _ in range(128))
        rows += [(2 * k, head + "".join("2:" if b else "CL" for b in word) + " " * 16), (2 * k + 1, head + "".join("CL" if b else "2:" for b in word) + " " * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(len(t) == 400 for _, t in rows)
    assert collected(substrings.dedup_report(docs), *REPORT) == plain_report(rows, 400)


def test_what_is_written_on_the_way_is_freed(spark):
    before = {t.name for t in spark.catalog.listTables()}
    substrings.dedup_report(spark.createDataFrame([(1, "a" * 900), (2, "b")], "doc_id long, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_of_random_edits(spark, seed):
    rows = edited(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(substrings.dedup_report(docs), *REPORT) == plain_report(rows, 400)


def test_cuts_inside_characters(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefg ") for _ in range(450))
    rows = [(0, "p é" + shared + "é end"), (1, "q ũ" + shared + "ã end"), (2, "clean � text"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(substrings.dedup_report(docs), *REPORT) == plain_report(rows, 400)
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}
    assert got == {0: "p  end", 1: "q  end", 2: "clean � text", 3: None}


def test_chunks_agree_with_one_pass(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd ") for _ in range(5000))
    rows = [(0, long), (1, "q" + long[700:4000]), (2, long[100:900] + "!" + long[100:1200]), (3, "w" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    before, substrings.CHUNK = substrings.CHUNK, 700
    try:
        raw = [t.encode() for _, t in rows]
        whole = {x for part in substrings.anchors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])) for x in zip(*(v.tolist() for v in part[:2]), strict=True)}
        substrings.CHUNK = before
        once = {x for part in substrings.anchors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])) for x in zip(*(v.tolist() for v in part[:2]), strict=True)}
        assert whole == once
        assert collected(substrings.dedup_report(docs), *REPORT) == plain_report(rows, 400)
    finally:
        substrings.CHUNK = before
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def check_packing(layout, texts_by_id, capacity=1024):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins, pieces = defaultdict(list), Counter()
    for r in layout:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want, total = Counter(), 0
    for i, t in texts_by_id:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b]))] += 1
        total += len(ids)
    assert pieces == want
    return len(bins), -(-total // capacity)


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    used, least = check_packing(packing.pack(docs, path, 2).collect(), [(r[0], r[1]) for r in rows])
    assert used <= least + 2 and packing.pack(empty, path, 2).count() == 0


def test_plan_is_close_to_the_least():
    rng = random.Random(4)
    for _ in range(20):
        counts = Counter(rng.randint(1, 1024) for _ in range(5000))
        bins = packing.plan_bins(counts)
        placed = Counter()
        for kind, n in bins:
            assert sum(kind) <= 1024 and n > 0 and sum(3 * s > 1024 for s in kind) <= 2
            for s in kind:
                placed[s] += n
        assert placed == counts and sum(n for _, n in bins) <= 1.03 * sum(s * n for s, n in counts.items()) / 1024 + 2


def plain_spans(rows):
    """The rule itself, by loops over all spans."""
    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    seen = defaultdict(list)
    for d, (i, t) in enumerate(distinct):
        for first, end, said in sentences.spans(sentences.sentences(t)):
            seen[said].append((d, first, end))
    gone = defaultdict(set)
    for places in seen.values():
        for d, first, end in places[1:]:
            gone[d] |= set(range(first, end))
    out = {}
    for d, (i, t) in enumerate(distinct):
        parts = sentences.sentences(t)
        assert "".join(parts) == t
        out[(i, t)] = len(parts), len(gone[d]), "".join(p for k, p in enumerate(parts) if k not in gone[d])
    return Counter((r[0], *out[(r[0], r[1] or "")]) for r in rows)


def test_sentence_spans(docs, rows, empty):
    unique = [r for r in rows if r[0] is not None and not r[1:2] == ("another text of a repeated id",)]
    frame = docs.filter("doc_id IS NOT NULL AND (text IS NULL OR text <> 'another text of a repeated id')")
    assert collected(sentences.drop_repeated_spans(frame), "doc_id", "n_sentences", "n_removed", "kept") == plain_spans(unique)
    assert sentences.drop_repeated_spans(docs).count() == len(rows) and sentences.drop_repeated_spans(empty).count() == 0


def test_sentence_spans_of_null_and_repeated_ids(spark):
    rng = random.Random(13)
    told, other, own = "".join(words(rng, 9, ". ") for _ in range(4)), "".join(words(rng, 8, ". ") for _ in range(3)), words(rng, 30, ". ")
    rows = [(None, told), (None, told), (None, other), (1, own + told), (1, own + other), (1, own + other), (2, None), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["kept"]) for r in sentences.drop_repeated_spans(docs).collect())
    # nulls come first; of the two texts of doc_id 1 the one of the lesser hash keeps what both begin with
    first, second = ((i, own + told), (i, own + other)) if (i := 1) and key_of(spark, own + told) < key_of(spark, own + other) else ((i, own + other), (i, own + told))
    keeps_own = first[1]
    want = Counter({(None, told): 2, (None, other): 1, (2, ""): 2, (None, ""): 1})
    for i, t in rows[3:6]:
        want[i, own if t == keeps_own else ""] += 1
    assert got == want


def key_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64(F.md5("t"))).first()[0]


def words(rng, n, end=""):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + end


def kept_words(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r["kept"].split() for r in sentences.drop_repeated_spans(frame).orderBy("doc_id").collect()]


def test_repeated_runs_go_up_to_their_last_sentence(spark):
    rng = random.Random(6)
    told = [words(rng, n, ". ") for n in (7, 5, 9, 3, 8, 2, 4)]
    own = [words(rng, 9, ". ") for _ in range(4)]
    whole, short = "".join(told), "just four words here."
    few = told[0] + told[1]
    got = kept_words(spark, [whole, own[0] + whole + own[1], whole, short, short, few, few, own[2] + few + own[3]])
    plain = [whole, own[0] + own[1], "", short, "", few, "", own[2] + few + own[3]]
    assert got == [t.split() for t in plain]


def test_repeated_runs_equal_all_runs_of_sentences(spark):
    """Every run of two sentences and 16 words, by loops that do not call spans()."""
    rng = random.Random(7)
    told = [words(rng, n, ".") for n in (1, 2, 3, 5, 6, 8, 9, 11, 13, 14)]
    texts = [[rng.choice(told) for _ in range(rng.randint(4, 30))] for _ in range(60)]
    seen, plain = set(), []
    for t in texts:
        gone = set()
        for i in range(len(t)):
            for e in range(i + 2, len(t) + 1):
                said = " ".join(t[i:e])
                if said.count(" ") + 1 >= 16:
                    gone |= set(range(i, e)) if said in seen else set()
                    seen.add(said)
        plain.append(" ".join(x for k, x in enumerate(t) if k not in gone).split())
    assert kept_words(spark, [" ".join(t) for t in texts]) == plain


def test_long_sentences_are_cut_alike_wherever_text_begins(spark):
    rng = random.Random(8)
    for _ in range(20):
        passage = words(rng, 60)
        one, two = sentences.sentences(passage), sentences.sentences(words(rng, rng.randint(1, 40), " ") + passage + " " + words(rng, 30))
        assert all(len(p.split()) <= 16 for p in one + two) and len({p.strip() for p in one} & {p.strip() for p in two}) >= len(one) - 4
    passages = [words(rng, 60) for _ in range(10)]
    texts = [t for p in passages for t in (words(rng, 31, " ") + p + " " + words(rng, 40), words(rng, 12, " ") + p + " " + words(rng, 25))]
    got = kept_words(spark, texts)
    assert got[::2] == [t.split() for t in texts[::2]]
    assert all(set(words_of_own(t, p)) <= set(k) and len(k) <= 12 + 25 + 32 for t, p, k in zip(texts[1::2], passages, got[1::2], strict=True))


def words_of_own(text, passage):
    return [w for part in text.split(passage) for w in part.split()]


def test_a_piece_of_sixteen_words_is_a_span():
    rng = random.Random(9)
    piece, end = words(rng, 16), words(rng, 3)
    assert (0, 1, piece.encode()) in sentences.spans([piece + " ", end])
    assert (1, 2, piece.encode()) in sentences.spans([end + " ", piece])


def test_pipeline(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    judged = quality.quality(spark.createDataFrame(rows, SCHEMA)).filter("kept").select("doc_id", "text", "source").collect()
    live = [(r["doc_id"], r["text"], r["source"]) for r in judged]
    roots = plain_wide_roots([t for _, t, _ in live])
    by = defaultdict(list)
    for r, root in zip(live, roots, strict=True):
        by[root].append(r)
    kept = []
    for group in by.values():
        least = min((g[0] for g in group if g[0] is not None), default=None)
        kept.append([g for g in group if g[0] == least])
    assert all(len({t for _, t, _ in k}) == 1 for k in kept)
    kept = [k[0] for k in kept]
    cut = plain_cut([t.encode() for _, t, _ in kept], substrings.SHORT)
    texts = [(i, b.decode(errors="ignore"), s) for (i, _, s), (_, _, b) in zip(kept, cut, strict=True)]
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    check_packing(got, [(i, t) for i, t, _ in texts for _ in range(copies[(i, len(t.split()))])])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, rows):
    clash = ["row", "k", "k1", "found", "n", "copies", "root", "kept", "__hot", "size", "fp"]
    docs = spark.createDataFrame([(*r[:5], *clash) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(r["row"] == "row" and r["found"] == "found" and r["__hot"] == "__hot" for r in out.select("row", "found", "__hot").collect()), name


def test_chat_of_clashing_columns_and_long_texts(spark):
    long = "<|im_end|> \\ <|im_start|>" * 20_000
    rows = [(1, 0, "user", long, "x", "y"), (1, 1, "assistant", long + "!", "x", "y"), (None, 0, "assistant", None, "x", "y"), (2, 0, None, "\n", "x", "y")]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, place string, formatted string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.messages_as_events(talk)))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", long), ("assistant", long + "!")] and back[1]["loss_text"] == long + "!"
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("assistant", "")] and [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "\n")]


def test_every_query_runs_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in entries.queries().items():
        got = query(spark, sf)
        assert got.count() >= n or name == "op6_chat"


def test_spans_of_a_long_text_among_many_go_back_in_parts(spark):
    long = " ".join(f"Word {i} of sentence {i} goes on with {i % 97} others." for i in range(6_000))
    rows = [(k, k, f"Short text number {k} has a few words. It ends here.") for k in range(40)] + [(90, 90, long), (91, 91, ""), (None, 92, "One.")]
    docs = spark.createDataFrame(rows, "doc_id long, k long, text string").coalesce(1)
    names = ("doc_id", "k", "first", "end", "h1", "h2")
    whole = collected(sentences._span_table(docs, sentences.RUN, sentences.WORDS, 1 << 30), *names)
    assert len(whole) > 6_000 and whole == collected(sentences._span_table(docs, sentences.RUN, sentences.WORDS, 7), *names) == collected(sentences._span_table(docs, sentences.RUN, sentences.WORDS), *names)
