"""Packing, decontamination, archives, URL verdicts and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factorlake.llm import latent_decontam as D, packing as P, queries, url_terms as U, warc_index as A
from factorlake.session import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"{a}{b}{c}" for a in "ba ce di fo gu hy".split() for b in "ran sel tim vor wex".split() for c in ("", "ish", "oon", "ed")]


def phrase(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_encoder_equals_the_tokenizer():
    texts = ["it's <|endoftext|> a", "x y", "ÀÉ’s don't WE'LL ''s 's", "١٢٣ ²³½ a_b __", "İstanbul Σας", "\x1c a\x85b", "éa", "a'sb 'll'd!!'", "日本 語,word.", "ŁÓDŹ ŉ ǅ", "", " \n\t", "plain, text. again"]
    encode, whole = P._Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts * 2)] == [whole.encode(t, add_special_tokens=False).ids for t in texts] * 2


def check_packed(rows, n_docs, capacity, texts):
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == n_docs
    whole = Tokenizer.from_file(TOKENIZER)
    for doc, got in pieces.items():
        ids = np.array(whole.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        assert sorted(got) == list(range(-(-len(ids) // capacity)))
        for k, r in got.items():
            part = ids[k * capacity:(k + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (k * capacity, len(part), zlib.crc32(part.tobytes()))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packed_sequences_are_gapless_and_few(spark):
    rng = random.Random(1)
    texts = [phrase(rng, rng.choice([1, 5, 20, 60, 90, 400])) for _ in range(150)] + ["", None, phrase(rng, 20)] * 3
    rows = P.pack(frame(spark, texts), TOKENIZER, capacity=128).collect()
    used = check_packed(rows, len(texts), 128, texts)
    total = sum(r.length for r in rows)
    assert used <= -(-total // 128) + 2
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_meets_the_lower_bound_or_nearly(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400) if seed % 2 else np.minimum(100, rng.geometric(0.03, 400))
    slots = P.plan(np.bincount(lengths, minlength=101), 100)
    used = max(s + t for s, t in [(r[2], 1) for r in slots])
    large = int((lengths > 50).sum())
    assert used <= max(-(-int(lengths.sum()) // 100), large) * 1.03 + 2


def test_packing_edge_rows(odd_docs, no_docs, spark):
    rows = P.pack(odd_docs, TOKENIZER).collect()
    assert len(rows) == 10 + 7 and sum(r.length == 1 for r in rows) == 3  # 30,001 words: eight pieces
    assert P.pack(no_docs, TOKENIZER).count() == 0
    same = P.pack(frame(spark, ["one two"] * 300), TOKENIZER, capacity=9).collect()
    assert len({(r.sequence_id, r.offset) for r in same}) == 300


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    items = [phrase(rng, rng.randint(16, 60)) for _ in range(30)]
    docs, want, close = [], set(), set()
    for i in range(400):
        text = phrase(rng, rng.randint(30, 400)).split()
        at, kind = rng.randrange(len(text)), i % 10
        if kind == 0:
            k = rng.randrange(30)
            docs.append(" ".join(text[:at] + [items[k].upper().replace(" ", ",\n")] + text[at:]))
            want.add((i, k))
        elif kind == 1:
            k = rng.randrange(30)
            w = [rng.choice(WORDS) if rng.random() < 0.12 else x for x in items[k].split()]
            docs.append(" ".join(text[:at] + w + text[at:]))
            close.add((i, k))
        elif kind == 2:
            docs.append(" ".join(text[:at] + rng.choice(items).split()[3:11] + text[at:]))
        else:
            docs.append(" ".join(text))
    docs += ["", None]
    return frame(spark, docs), spark.createDataFrame([*enumerate(items), (98, ""), (99, None)], "item_id long, text string"), want, close


def test_planted_items_are_found_and_clean_documents_left_alone(planted):
    docs, items, want, close = planted
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert want <= got and len(close & got) >= 0.9 * len(close)
    assert {d for d, _ in got} <= {d for d, _ in want | close}
    left = D.without_leaks(docs, items)
    assert {r.doc_id for r in left.collect()} == set(range(402)) - {d for d, _ in got} and left.columns == docs.columns


def test_common_subsequence_is_exact():
    rng = random.Random(2)
    for _ in range(100):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 12))], [rng.randrange(6) for _ in range(rng.randint(0, 15))]
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert D.common_length(masks, len(a), b) == table[-1][-1]


def test_a_long_text_is_searched_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    item = phrase(rng, 40)
    text = phrase(rng, 30_000) + " " + item + " " + phrase(rng, 500)
    docs = frame(spark, [text] + [phrase(rng, 100) for _ in range(50)])
    got = D.contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.common_share) for r in got] == [(0, 1.0)]
    coded = D.encoded(docs)
    one = D.leaks(coded, spark.createDataFrame([(0, item), (1, item)], "item_id long, text string"), D.Settings(items_per_block=1)).collect()
    assert sorted(r.item_id for r in one) == [0, 1]


def test_decontamination_edge_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, ""), (3, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contaminated(odd_docs, items).collect()) == [1, 2, 2, 7]
    left = D.without_leaks(odd_docs, items)
    assert left.count() == 6 and left.columns == odd_docs.columns
    assert D.contaminated(no_docs, items).count() == 0 and D.without_leaks(odd_docs, items.limit(0)).count() == 10


def test_archives_come_back_whole(spark):
    big = "<p>é</p>" * 40
    rows = [(1, "http://www.a.com/x?q=1", big), (2, "http://a.com/", big), (3, None, "small"), (4, "http://b.org/%0A\n", "small"), (5, "http://a.com/", None), (6, "http://a.com/#f", ""), (7, "no scheme", "a\r\n\r\nb" * 50),
            (None, "http://n.com/", big), (2, "http://a.com/", big), (8, "http://a.com:80/y", big + "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = A.round_trip(pages, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        htmls = [h or "" for i, u, h in rows if i == r.page_id and u == r.url]
        body = htmls[0].encode()
        copy = htmls[0] == big and r.page_id != 1
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 1, None) if copy else ("response", None, body))
    assert A.round_trip(pages.limit(0)).count() == 0


def test_lookup_reads_only_by_index(spark, monkeypatch):
    monkeypatch.setattr(A, "LINES_PER_BLOCK", 3)
    rows = [(i, f"http://h{i % 7}.com/p{i % 11}", f"<p>{i}</p>" * 30) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    at = f"{shared_folder(spark)}/look"
    A.write_archives(pages, f"{at}/archives")
    A.write_index(A.captures(spark, f"{at}/archives"), f"{at}/index")
    got = A.lookup(spark, f"{at}/archives", f"{at}/index", ["https://H3.com/p4#x", "http://none.com/"])
    want = [(i, h.encode()) for i, u, h in rows if u == "http://h3.com/p4"]
    assert sorted((r["page_id"], r["payload"]) for r in got) == want
    assert spark.read.parquet(f"{at}/index/directory").count() >= 20


def test_url_verdicts(spark):
    cases = [(None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://EXAMPLE.com/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
             ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://a.www.example.com/EN/", "a.www.example.com", "/EN/", "com/", "allow"), ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
             ("http://x.net/es", "x.net", "/es", None, "allow"), ("http://mynet/es/", "mynet", "/es/", None, "allow"), ("http://x.org/a/://b", "x.org", "/a/://b", None, "allow"), ("http://x.com", "x.com", "", None, "allow"),
             ("http://x.org/porn", "x.org", "/porn", None, "block"), ("http://x.org/pornography", "x.org", "/pornography", None, "allow"), ("http://x.org/casino/poker", "x.org", "/casino/poker", None, "block"),
             ("http://x.org/casino-casino", "x.org", "/casino-casino", None, "allow"), ("http://x.org?bet=1#free", "x.org", "", None, "block"), ("http://éads.org/loan", "éads.org", "/loan", None, "block")]
    rows = U.judge(spark.createDataFrame([(c[0], "host") for c in cases] + [(cases[3][0], "again")], "url string, host string")).collect()
    assert [(r.url, *r.judged[:4]) for r in rows[:-1]] == cases and rows[-1].judged == rows[3].judged
    assert U.judge(spark.createDataFrame([], "url string")).count() == 0


def test_pipeline_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rng = random.Random(3)
    item = phrase(rng, 30)
    clean = [phrase(rng, 80) for _ in range(30)]
    texts = clean + [clean[0], item + " " + phrase(rng, 50), "123 456", None] + [phrase(rng, 60) + "\nshared line" for _ in range(12)]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    own = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns == own
        kept.append({r.doc_id for r in docs.collect()})
    everyone = set(range(len(texts)))
    assert kept == [everyone - {32, 33}, everyone - {32, 33}, everyone - {30, 32, 33}, everyone - {30, 31, 32, 33}]
    assert docs.where("text like '%shared line%' or n_chars <> length(text)").count() == 0
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(rows, len(kept[-1]), 4096, {r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("pieces, most", [({2050: 120, 1100: 120, 511: 480}, 160), ({2000: 1, 1000: 1, 10: 100}, 1), ({2050: 1, 511: 4}, 1), ({3000: 2, 137: 16}, 2)])
def test_fillings_of_many_pieces_are_found(pieces, most):
    counts = np.zeros(4097, np.int64)
    counts[list(pieces)] = list(pieces.values())
    slots = P.plan(counts, 4096)
    ends, sequences = defaultdict(list), 0
    for (length, rank, sequence, offset), after in zip(slots.tolist(), [*slots.tolist()[1:], None]):
        n = (after[1] if after and after[0] == length else pieces[length]) - rank
        sequences = max(sequences, sequence + n)
        for k in range(n):
            ends[sequence + k].append((offset, length))
    assert sequences == len(ends) <= most
    assert sum(map(len, ends.values())) == sum(pieces.values())
    for taken in ends.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_keeps_one_document_of_many_copies(spark):
    rng = random.Random(8)
    lines = [phrase(rng, 4) for _ in range(9)]
    copies = ["\n".join(lines)] * 12
    near = [[phrase(rng, 6) for _ in range(20)] for _ in range(1)] * 12
    near = ["\n".join([*ls[:i], phrase(rng, 6), *ls[i + 1:]]) for i, ls in enumerate(near)]
    long = phrase(rng, 30)
    own = [phrase(rng, 60) + "\n" + long + "\nshort line" for _ in range(12)]
    docs = frame(spark, copies + near + own).withColumn("n_chars", F.char_length("text"))
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got[0].text == copies[0] and all(got[i].text == "" for i in range(1, 12))
    kept = [line for i in range(12, 24) for line in got[i].text.split("\n")]
    assert all(kept.count(line) == 1 for line in near[0].split("\n")[12:]) and len(got[12].text.split("\n")) >= 19
    assert sum(long in got[i].text for i in range(24, 36)) == 1 and not any("short line" in r.text for r in got.values())
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_pipeline_keeps_clean_texts_without_any_known_language(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34 !", None), (3, None, None), (4, "слово", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]


def five(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_pipeline_removes_near_copies_of_similarity_above_four_fifths(spark):
    rng = random.Random(9)
    texts = []
    for k in range(60):
        words = phrase(rng, 200).split()
        texts.append(" ".join(words))
        for at in rng.sample(range(5, 195), k % 6 + 1):
            words[at] = "changed" + str(at)
        texts.append(" ".join(words))
    like = [len(five(a) & five(b)) / len(five(a) | five(b)) for a, b in zip(texts[::2], texts[1::2])]
    near = {2 * k + 1 for k, s in enumerate(like) if s >= 0.8}
    assert len(near) >= 30 and sum(0.8 <= s < 0.9 for s in like) >= 10 and sum(0.7 < s < 0.8 for s in like) >= 5
    gone = set(range(120)) - {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect()}
    assert gone <= near and len(gone) >= 0.98 * len(near)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def sequences_of(pieces, capacity):
    """Number of sequences of the plan for ``pieces`` {length: count}; every slot is checked."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.items():
        counts[length] = n
    slots = P.plan(counts, capacity).tolist()
    taken = defaultdict(list)
    for (length, rank, sequence, offset), after in zip(slots, [*slots[1:], None]):
        for k in range((after[1] if after and after[0] == length else pieces[length]) - rank):
            taken[sequence + k].append((offset, length))
    for row in taken.values():
        ends = np.cumsum([length for _, length in sorted(row)])
        assert [o for o, _ in sorted(row)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert sum(map(len, taken.values())) == sum(pieces.values())
    return len(taken)


def fewest_bins(pieces, capacity):
    """Optimum over all subsets."""
    best = [(99, 0)] * (1 << len(pieces))
    best[0] = (1, 0)
    for done in range(1 << len(pieces)):
        bins, full = best[done]
        for i, p in enumerate(pieces):
            if not done >> i & 1:
                step = (bins, full + p) if full + p <= capacity else (bins + 1, p)
                best[done | 1 << i] = min(best[done | 1 << i], step)
    return best[-1][0]


@pytest.mark.parametrize("copies", [1, 1000])
def test_branch_and_bound_beats_the_best_fit_plan(copies):
    assert sequences_of({x: copies for x in (48, 44, 42, 39, 35, 31, 29, 20)}, 100) == 3 * copies


def test_small_instances_are_packed_optimally():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        capacity = int(rng.choice([10, 30, 100]))
        pieces = [int(rng.integers(1, capacity + 1)) if rng.random() < .3 else int(rng.integers(max(1, capacity // 8), capacity // 2 + 1)) for _ in range(int(rng.integers(1, 10)))]
        lengths, n = np.unique(pieces, return_counts=True)
        assert sequences_of(dict(zip(lengths.tolist(), n.tolist())), capacity) == fewest_bins(pieces, capacity)


def test_a_worker_loads_the_tokenizer_once_and_cuts_plain_words_without_a_pattern():
    """Tasks of one worker share the words they know; new words do not pass the pattern of the tokenizer again."""
    assert P._encoder(TOKENIZER) is P._encoder(TOKENIZER)
    words = ["word", "word.", "don't", "it's!", "'s", "a'b.c", "x_y_", "12", "a1", "über,", "naïve'", "...", "'", "é***", "²", "ª.", "a-b", "(see", "'tis"]
    assert [P._cut(w) for w in words] == [P.PART.findall(w) for w in words]
    encode = P._Encoder(TOKENIZER)
    assert [part for part, _ in encode.plain.pre_tokenizer.pre_tokenize_str("don't")] == ["don't"]
    whole = Tokenizer.from_file(TOKENIZER)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([" ".join(words)] * 2)] == [whole.encode(" ".join(words), add_special_tokens=False).ids] * 2


def test_a_worker_keeps_the_word_hashes_it_knows():
    """Later tasks of a worker find the runs of earlier ones; a run is hashed word by word whatever stands around the words."""
    import xxhash

    assert D._known() is D._known()
    runs = ["word", "word.", "don't", "it's!", "x_y_", "_", "12a", "über,", "...", "é***", "²", "a-b", "(see", "日本", "١٢٣", "_a", "a_", "n\u0303o"]
    known = D._Known()
    for _ in range(2):
        assert D.word_ids(" ".join(runs), known) == b"".join(xxhash.xxh32_digest(w) for run in runs for w in D.WORD.findall(run))
    assert len(known) == len(runs) and D.word_ids(None, known) == b""


def test_words_of_many_texts_are_hashed_together(monkeypatch):
    """The bytes are those of one digest per word, for words of any size and script, and only long words cost a call."""
    import xxhash

    rng = random.Random(8)
    signs = "abzAZ09ßéÄİΣσñ日本١²ⅷ_-'.,!… \n\t\u0085  ×÷̃😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += [None, "", " ", "\n", "_", "x", "x" * 15, "x" * 16, "é" * 8, " ".join("w" * n for n in range(1, 40)), "ΟΔΟΣ ΟΔΟΣ. ΣΑΣ"]
    want = [b"".join(map(xxhash.xxh32_digest, D.WORD.findall((t or "").lower()))) for t in texts]
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(D, "CHUNK_BYTES", size)
        assert list(D.texts_ids(texts)) == want
    assert list(D.texts_ids([])) == []
    called = []
    monkeypatch.setattr(D, "xxhash", type("Counted", (), {"xxh32_intdigest": lambda w: called.append(w) or xxhash.xxh32_intdigest(w)}))
    list(D.texts_ids([" ".join(f"word{i}" for i in range(5_000)) + " " + "y" * 16]))
    assert called == [b"y" * 16]


def test_documents_are_searched_together(monkeypatch):
    """Many documents share their sums and products; what each of them gives is what it gives alone."""
    rng, numbers = random.Random(9), np.random.default_rng(9)
    items = [phrase(rng, n) for n in (3, 12, 24, 40, 57)]
    texts = [phrase(rng, rng.choice((1, 7, 8, 9, 23, 24, 25, 90))) for _ in range(300)]
    for k in range(0, 300, 3):
        texts[k] = " ".join([*phrase(rng, k % 19).split(), items[k % 5], texts[k]])
    basis, idf, found = numbers.standard_normal((D.FEATURES, 16), dtype=np.float32), np.ones(D.FEATURES, np.float32), {}
    known = D._Items([(i, ids) for i, ids in enumerate(np.frombuffer(x, np.uint32) for x in D.texts_ids(items))], basis, idf, D.Settings())
    parts = [(row, ids, 0, ids) for row, ids in enumerate(np.frombuffer(x, np.uint32) for x in D.texts_ids(texts))]
    calls, add = [], D._sum_rows
    monkeypatch.setattr(D, "_sum_rows", lambda *a: calls.append(1) or add(*a))
    known.find(D._and_zero(basis), parts, found)
    assert len(calls) == 2 and len(found) > 80
    alone = {}
    for row, ids, _, _ in parts:
        cells = np.zeros((-(-len(ids) // D.CELL) + D.CELLS, 16), np.float32)
        for at in range(len(ids)):
            cells[at // D.CELL] += basis[ids[at] % D.FEATURES]
        for w in range(-(-len(ids) // D.CELL)):
            near = D._unit(cells[w:w + D.CELLS].sum(axis=0, keepdims=True)) @ known.vectors.T
            words = ids[w * D.CELL:w * D.CELL + D.PASSAGE] % D.FEATURES
            for g in np.flatnonzero(near[0] >= known.limits).tolist():
                if known.table[known.owner[g], words].sum() >= known.least[known.owner[g]] and (hit := known.check(ids, w * D.CELL, g)):
                    if (row, hit[0]) not in alone or (hit[1], near[0, g]) > (alone[row, hit[0]][1], alone[row, hit[0]][0]):
                        alone[row, hit[0]] = (near[0, g], *hit[1:])
    assert found.keys() == alone.keys() and all(abs(found[k][0] - alone[k][0]) < 1e-4 and found[k][1:] == alone[k][1:] for k in alone)


def test_sums_over_lines_and_groups_are_whole():
    rng = np.random.default_rng(10)
    table, sizes = D._and_zero(rng.integers(0, 9, (50, 3)).astype(np.float32)), np.array([0, 1, 7, 8, 9, 0, 64, 65, 1000, 0])
    rows = rng.integers(0, 50, sizes.sum())
    total, ends = np.ones((10, 3)), np.cumsum(sizes)
    D._add_groups(total, table, rows, sizes)
    want = np.array([1 + table[rows[e - n:e]].sum(axis=0) for n, e in zip(sizes, ends)])
    assert (total == want).all()
    lines, counts = D._lines(rows, sizes, 8, 50)
    assert counts.tolist() == [0, 1, 1, 1, 2, 0, 8, 9, 125, 0] and (lines < 50).sum() == len(rows)
    assert D._sum_rows(table, lines[:0]).shape == (1, 3)
