"""Token alignment, runs of words and toxicity against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symcorpus.llm import alignment, encoders, entries, periods, shared, token_counts, toxicity

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_words long, row string, part string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, "r", "p") for i, t in zip(ids, texts, strict=True)], DOCS)


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "é", "th", "oß", "in", "日本", "🙂", "Qq", "'s"]) for _ in range(rng.randint(1, 5)))
    prose = [" ".join(word() for _ in range(n)) for n in (1, 7, 40, 300)]
    return [
        None, "", " ", "a", "  two  spaces ", "tab\there\n \n there\r\n", "▁ marks ▁▁", "<s> </s> <unk> <|endoftext|> <0x41>", "x" * 3000, "ab" * 700 + "\0", "𠀀" * 64, "é ﬁ ½",
        *prose, prose[3], "don't I'll we've\n\n\nyes", "1234567 89.5%",
    ]


def plain_report(texts):
    """The contract of op11 token by token."""
    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_lib.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    vocabulary = {i: w for w, i in a_lib.get_vocab().items()}

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    found = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = [(i, bytes(letters[c] for c in vocabulary[i])) for i in a_lib.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, piece(i)) for i in b_lib.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append(None)
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, low = [], 0
        for z in cuts:
            groups.append(tuple([i for i, s, e in own if low <= s and e <= z] for own in spans))
            low = z
        found.append((len(a), len(b), groups, links))
    counts = Counter(x for f in found if f for x in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        shared_ = sum(len(x) * len(y) for x, y in f[2])
        out.append((f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(said.encode()).hexdigest(), shared_))
    return out


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3, 0])
def test_alignment_is_that_of_single_tokens(spark, frequent, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 64)
    texts = odd_texts()
    docs = table(spark, texts).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.link_report(docs, *PATHS, frequent=frequent).collect()}
    assert got == dict(enumerate(plain_report(texts)))


def test_alignment_keeps_repeated_rows_null_ids_and_empty_tables(spark):
    docs = table(spark, ["one text", "one text", None], [None, 4, 4])
    rows = alignment.link_report(docs, *PATHS).orderBy("n_a", "doc_id").collect()
    assert [r["doc_id"] for r in rows] == [4, None, 4] and rows[1]["groups_sha256"] == rows[2]["groups_sha256"] and rows[0]["groups_sha256"] == ""
    assert alignment.link_report(docs.limit(0), *PATHS).count() == 0


def test_links_are_the_product_of_incidence_matrices(spark):
    texts = odd_texts()
    for r in alignment.links(table(spark, texts), *PATHS).collect():
        pairs = [(i, j) for i in range(len(r["a_ids"])) for j in r["link_cols"][r["link_rows"][i] : r["link_rows"][i + 1]]]
        assert len(pairs) == len(set(pairs)) == len(r["shared_bytes"])
        if r["a_ids"]:
            assert sum(r["shared_bytes"]) == len(texts[r["doc_id"]].encode()) + 1
            assert all(r["a_group"][i] == r["b_group"][j] for i, j in pairs)


def test_sparse_products():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.random((7, 9)) < 0.3, rng.random((9, 5)) < 0.3
        csr = lambda m: alignment.Csr(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1])
        got, values = alignment.product(csr(a), csr(b), 5)
        dense = np.zeros((7, 5), int)
        for i in range(7):
            dense[i, got.cols[got.rows[i] : got.rows[i + 1]]] = values[got.rows[i] : got.rows[i + 1]]
        assert (dense == a.astype(int) @ b.astype(int)).all()
        assert (alignment.transposed(csr(a), 9).cols == csr(a.T).cols).all()


def lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(s, least=6, times=4):
    """Runs by trying every period."""
    found = set()
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(all(s[i + x] == s[i + x + d] for x in range(size - d)) for d in range(1, q)):
                found.add((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, kinds = rng.randint(1, 70), rng.choice([1, 2, 2, 3, 6, 40])
    s = [rng.randrange(kinds) for _ in range(n)]
    if rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


def test_runs_are_those_of_all_periods():
    rng = random.Random(8)
    for _ in range(1500):
        s = some_words(rng)
        assert periods.lyndon_array(s) == lyndon(s)
        runs = plain_runs(s)
        assert periods.runs_of(np.array(s)) == runs
        assert periods.periodic_runs(periods.word_codes(s)) == runs
    three = [0, 1] * 3 + [5] + [2] * 9
    assert periods.periodic_runs(periods.word_codes(three), 6, 3) == plain_runs(three, 6, 3) == [(0, 6, 2), (7, 9, 1)]


def test_word_runs_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n", "a " * 9, "x\x0by\tz\n" * 6 + "end", "no-break\xa0space\x85here " * 5, *(" ".join(f"w{x}" for x in some_words(rng)) for _ in range(120))]
    ids = [*range(len(texts) - 2), None, 1]
    path = str(tmp_path / "documents.parquet")
    table(spark, texts, ids).repartition(4).write.parquet(path)
    got = {(r["doc_id"], r["runs_sha256"], r["collapsed_sha256"]): r for r in entries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    made = 0
    for doc_id, text in zip(ids, texts, strict=True):
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            made += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        r = got[doc_id, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert made > 3


def plain_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then those to its left and right."""

    def cut(a, z):
        best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0, 0, 0, 0, 0))
        if best[0] <= 0:
            return []
        return cut(a, best[3]) + [(best[3], best[4], best[0])] + cut(best[4], z)

    return cut(0, len(scores))


def test_segments_are_maximal():
    rng = random.Random(6)
    for _ in range(400):
        scores = [rng.choice([-4.5, -2.25, -1.125, 0.5, 1.0625, 3.03125]) + rng.random() / 1000 for _ in range(rng.randint(0, 22))]
        got = toxicity.segments(np.array(scores))
        assert [(s.start, s.end) for s in got] == [(a, z) for a, z, _ in plain_segments(scores)]
        assert np.allclose([s.score for s in got], [v for *_, v in plain_segments(scores)])


def test_log_odds_lean_on_prefixes():
    model = toxicity.LogOdds({"abus*": (30, 1), "abusively": (0, 40)}, 100, 900)
    assert model["abusiveness"] > 0 > model["abusively"] and model["other"] < 0


def toxic_tables(spark, n=600):
    rng = random.Random(7)
    clean = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    bad = ["vilely", "scornful", "hateful", "vilest"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 200))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(4)]
        rows.append(" ".join(words))
        if i % 7:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None)]
    return table(spark, [*rows, None, ""]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found_where_labels_are_held_out(spark):
    docs, labels = toxic_tables(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(602) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0 and r["doc_id"] < 600) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    # held-out labels change nothing
    turned = labels.withColumn("toxic", F.when(toxicity.remainder() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, turned).collect()} == {(r["doc_id"], r["score"]) for r in rows}


def test_passages_point_at_toxic_words(spark):
    docs, labels = toxic_tables(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    hits = 0
    for r in toxicity.toxic_passages(docs, toxicity.fit(docs, labels)).filter("doc_id % 5 = 0 AND doc_id < 600").collect():
        words = toxicity.words(texts[r["doc_id"]])
        hits += any("vilely" in words[p["start"] : p["end"]] or "hateful" in words[p["start"] : p["end"]] for p in r["passages"])
    assert hits > 90


@pytest.mark.parametrize("some", ["toxic = 1", "toxic = 0", "false"])
def test_without_both_labels_every_score_is_their_share(spark, some):
    docs, labels = toxic_tables(spark, 60)
    rows = toxicity.toxicity(docs, labels.filter(some)).collect()
    assert len(rows) == 62 and len({r["score"] for r in rows}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_token_counts_of_rare_and_long_words(spark):
    texts = ["𠀀" * 64, "𠀀" * 64 + " a " + "𠀁" * 63, "ʷ" * 64 + " b", "x" * 64, None, ""]
    library = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table(spark, texts), PATHS[1]).collect()}
    assert got == {i: len(library.encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[0] > 255


def test_known_words_are_made_once_a_worker():
    one = encoders.piece_counter(PATHS[1], "k", "a b", np.array([1, 300], np.uint16))
    table_ = one.known
    assert encoders.piece_counter(PATHS[1], "k", "a b", np.array([1, 300], np.uint16)).known is table_ and table_ == {"a": 1, "b": 300}
    assert encoders.piece_counter(PATHS[1], "l").known == {} and shared.HEAVY
