"""Every operator on small fixtures: missing values, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import components, exact_dedup, language, lm, mixture, pieces, quality, simhash, token_files, toxicity, warc
from claimloom.llm.store import crc32_of, shared_folder

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [
    (1, "The cat sat on the mat, the cat sat."), (2, "Thecatsatonthe mat,\tthecatsat."), (3, None), (4, ""), (5, " \t\n"),
    (6, LONG), (6, LONG), (7, "é ü 日本 𝔘 \x00 <|endoftext|> x"), (8, "The cat sat on the mat, the cat sat."), (None, "no id here"),
    (9, "the CAT sat on the mat, the cat sat!"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _group int, `_MIX` int, _Toxicity string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][(i or 0) % 2], [None, "a", "b", "c"][(i or 0) % 4], None, 1, None, None, 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_exact_dedup_against_python(docs):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    found = exact_dedup.duplicate_groups(docs)
    group = found.columns[-1]
    assert group == "_group_"
    assert found.columns[:-1] == docs.columns
    for r in found.collect():
        body = re.sub(r"[\x20\x09-\x0d]", "", r.text or "")
        keep = min(groups[body])[2]
        assert (r[group].keep_id, r[group].group_size, r[group].kept) == (keep, len(groups[body]), r.doc_id == keep)
        assert r[group].text_sha256 == hashlib.sha256(body.encode()).hexdigest()
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min(g)[2]) for g in groups.values())


def test_exact_dedup_tells_colliding_texts_apart(docs):
    strong = exact_dedup.duplicate_groups(docs)
    weak = exact_dedup.duplicate_groups(docs, hashed=lambda body: F.unhex(F.substring(F.md5(body.cast("binary")), 1, 1)))
    key = lambda df: sorted(str((r.doc_id, r[df.columns[-1]])) for r in df.collect())
    assert key(weak) == key(strong)
    one = exact_dedup.duplicate_groups(docs, hashed=lambda body: F.unhex(F.lit("00")))
    assert key(one) == key(strong)


def test_mixture_targets_and_copies(spark, docs, nothing):
    plan = mixture.mixture_plan(docs, (5, 2, 1), 3.0, 1)
    mix = plan.columns[-1]
    rows = plan.collect()
    sizes = Counter()
    for i, t in TEXTS:
        sizes[[None, "a", "b", "c"][(i or 0) % 4]] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    for r in rows:
        s = r.source
        assert r[mix].source_size == sizes[s]
        assert r[mix].target == pytest.approx(target[s])
        assert r[mix].copies <= 3
        assert r[mix].size == len(WORD.findall(r.text or ""))
    taken = mixture.mixed(docs, (5, 2, 1), 3.0, 1)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r[mix].copies for r in rows)
    assert mixture.mixed(nothing, (5, 2, 1)).count() == 0


def test_token_files_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = token_files.encoded(spark, docs, path, 2).collect()
    want = sorted(((i is not None, i or 0, t or "") for i, t in TEXTS))
    rows.sort(key=lambda r: r.start)
    at = 0
    for r, (known, i, t) in zip(rows, want, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start) == (i if known else None, at)
        assert bytes(r.ids) == ids.tobytes()
        at += len(ids)
    assert token_files.encoded(spark, nothing, path, 2).count() == 0


def test_variable_length_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        packed = token_files.pack(values)
        assert (token_files.unpack(packed, n) == values).all()
    assert len(token_files.pack(np.array([1, 2, 300, 70_000], dtype=np.uint32))) == 1 + 1 + 1 + 2 + 3


@pytest.mark.parametrize("text", ["a\n b", "a \nb", "\n\n", "don't  stop", "a\x1cb c", "tab\there", "x!?. y", " lead", "trail ", "naïve, café."])
def test_encoder_equals_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_files.Encoder(path)
    ids, counts = encoder.encode([text, "", text + " more " + text])
    for k, t in enumerate((text, "", text + " more " + text)):
        ends = np.cumsum(counts)
        assert ids[ends[k] - counts[k] : ends[k]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_warc_round_trip_and_planted_magic(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    body = "<html>" + "é" * 60
    rows = [
        (1, "http://a/\r\n b", body), (2, None, body), (3, "u", None), (4, "u", ""), (5, "u", fake * 3 + body), (5, "u", "short"),
        (6, "u", "short"), (None, "u", body), (7, "u", body[:-1] + "x"), (8, "u", fake * 3 + body), (2, None, body),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = shared_folder(spark, "warc-test")
    warc.write_archives(warc.record_plan(pages, shard_bytes=2000), path)
    found = [tuple(r) for r in warc.read_archives(spark, path).collect()]
    first = {body: 1, fake * 3 + body: 5}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and i is not None and html in first and first[html] != i
        digest = hashlib.sha256(raw).hexdigest()
        want.append(("" if i is None else str(i), len(raw), digest, "revisit" if again else "response", str(first[html]) if again else None))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert warc.incomplete_files(spark, path).count() == 0
    empty = shared_folder(spark, "warc-test")
    warc.write_archives(warc.record_plan(pages.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_damage_ends_the_chain(spark):
    nodes = spark.createDataFrame([("f", 0, 10, 40), ("f", 10, 25, 40), ("f", 12, 20, 40), ("f", 30, 40, 40), ("g", 5, 9, 9)], "file string, at long, to long, size long")
    assert sorted(map(tuple, warc.reachable(nodes).collect())) == [("f", 0), ("f", 10)]


def test_language_model_learns_and_flags(spark, docs, nothing):
    rng = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "eit", "und"], "cc": ["ção", "ões", "que"]}
    rows = [(k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), lang) for k in range(60) for lang in [list(parts)[k % 3]]]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(train)
    assert model.languages == ("aa", "bb", "cc")
    got = {r.doc_id: r for r in language.identified(train, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 and not got[i].ambiguous for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "KALOMI kalo"), (4, "KALOMI kalo")], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.lang_pred) for r in language.identified(odd, model).collect())
    assert found == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa")]
    none = language.fit(nothing)
    assert {r.lang_pred for r in language.identified(docs, none).collect()} == {"und"}
    assert language.identified(nothing, model).count() == 0
    for n in (2, 3, 5, 9, 30):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()


def python_print(text, width=4):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(items, joined):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(items, 2):
        if joined(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in items}


def test_simhash_against_brute_force(spark, nothing):
    rng = random.Random(11)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400)]
    texts = {1: None, 2: "", 3: "Only three words", 4: "only THREE words", 5: "one", 6: " ".join(base)}
    for k in range(7, 60):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        texts[k] = " ".join(words)
    frame = spark.createDataFrame([*texts.items(), (6, texts[6])], "doc_id bigint, text string")
    prints = {i: python_print(t) for i, t in texts.items()}
    want = roots_of(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    rows = simhash.near_classes(frame).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_classes(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def test_long_posting_lists_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "POSTING", 8)
    rng = random.Random(5)
    prints = {i: 0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for i in range(1, 120)}
    frame = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "doc_id bigint, print binary")
    want = roots_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = frame.join(simhash.print_components(frame), "print").collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_covering_sets_hold_every_set_of_four():
    sets = simhash.covering_sets(8, 4)
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))


def test_near_copies_leave_one(spark):
    rng = random.Random(2)
    base = [f"word{rng.randrange(5000)}" for _ in range(600)]
    near = list(base)
    near[100] = "changed"
    other = [f"word{rng.randrange(5000)}" for _ in range(600)]
    rows = [(5, " ".join(base), 1), (3, " ".join(near), 2), (9, " ".join(other), 3), (None, " ".join(base), 4), (11, None, 5), (12, "", 6)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, _gone int"))
    assert kept.columns == ["doc_id", "text", "_gone"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "3", "9", "None"]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.root for r in components.components(frame).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert components.components(frame.limit(0)).count() == 0


def test_language_model_score(spark, docs, nothing, monkeypatch):
    for often in (lm.FREQUENT, 2):
        monkeypatch.setattr(lm, "FREQUENT", often)
        rows = lm.scored(docs, F.coalesce(F.col("doc_id") != 9, F.lit(True))).collect()
        tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
        counts = Counter(w for i, t in TEXTS if i != 9 for w in tokens(t))
        total, distinct = sum(counts.values()), len(counts)
        assert len(rows) == len(TEXTS)
        by = {(r.doc_id, r.n_tokens): r for r in rows}
        for i, t in TEXTS:
            r = by[(i, len(tokens(t)))]
            assert (r.n_known, r.train_tokens) == (sum(counts[w] > 0 for w in tokens(t)), total)
            assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)))
            assert r.score < 0 and r.bits_per_byte > 0
    assert lm.scored(nothing, F.lit(True)).count() == 0
    untaught = lm.scored(docs.where("doc_id = 1"), F.lit(False)).first()
    assert (untaught.train_tokens, untaught.n_known) == (0, 0)


def test_word_probabilities_add_up_to_less_than_one():
    """The bit model is a distribution over closed words: all words of one and two letters have less than all of it."""
    rng = np.random.default_rng(1)
    odds = rng.integers(-60, 60, (len(lm.CONTEXTS), 256 << lm.SLOT_BITS), dtype=np.int8)
    checks = rng.integers(0, 256, (len(lm.CONTEXTS), 1 << lm.SLOT_BITS)).astype(np.int16)
    letters = [bytes([b]) for b in range(256) if b not in b" \t\n\x0b\x0c\r"]
    words = letters + [a + b for a in letters for b in letters[:40]] + [lm.END]
    bits = lm.word_bits(words, (odds, checks), lm.first_weights(), lm.first_refinement())
    assert 0 < np.exp2(-bits).sum() < 1


def test_toxicity_learns_exact_neighbours(spark, docs, nothing):
    rng = random.Random(7)
    plain = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.sample(plain, 40)
        if i % 4 == 0:
            words[:2] = rng.sample(["nastyone", "nastytwo", "vile", "scummy"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0), None))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([*labels, (None, 1, None), (1, None, None), (2, 0, 1)], "doc_id bigint, toxic int, quality int")
    model = toxicity.fit(frame.where("doc_id < 300"), known)
    found = toxicity.scored(frame, model)
    out = found.columns[-1]
    for r in found.collect():
        assert r[out].predicted == int(r.doc_id % 4 == 0)
        assert 0 <= r[out].score <= 1
    # block-max search equals the full scan
    vectors = toxicity._Vectors(model.terms)
    dense = np.zeros((len(model.labels), len(model.terms)))
    for t in range(len(model.terms)):
        part = slice(model.starts[t], model.starts[t + 1])
        dense[model.example[part], t] = model.weight[part]
    for _, text in rows[300:]:
        numbers, weights = toxicity.vector(text, vectors, model.idf)
        cosine = dense[:, numbers] @ weights
        order = sorted(np.flatnonzero(cosine > 0).tolist(), key=lambda e: (-round(cosine[e], 9), e))[: toxicity.NEIGHBOURS]
        near, values = toxicity.nearest(model, numbers, weights)
        assert np.allclose(sorted(values), sorted(cosine[order]))
    odd = toxicity.scored(docs, model)
    assert odd.columns[-1] == "_toxicity_"
    assert {r[odd.columns[-1]].predicted for r in odd.collect()} == {0}
    assert toxicity.scored(nothing, model).count() == 0
    none = toxicity.fit(nothing, known)
    assert {r[odd.columns[-1]].predicted for r in toxicity.scored(docs, none).collect()} == {0}


def test_pieces_are_the_best_segmentation(spark, docs, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel(path)
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}

    def brute(text):
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for end in range(1, len(marked) + 1):
            ways = [best[s] + score[marked[s:end]] for s in range(max(0, end - 20), end) if marked[s:end] in score]
            if marked[end - 1] not in score:
                ways.append(best[end - 1] + model.unknown)
            best.append(max(ways))
        return best[-1]

    for text in ["The cat sat", "  two  blanks ", " ", "日本語 𝔘𝔘 x", "a\nb\tc", "é" * 30, "aaaa" * 20]:
        ids, value = model.encode(text)
        assert value == brute(text)
        assert model.decode(ids) == text
    rows = pieces.encoded(docs, path).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.restored for r in rows)
    assert {len(r.ids) for r in rows if r.doc_id in (3, 4)} == {0}
    assert not pieces.encoded(spark.createDataFrame([(1, "a▁b")], "doc_id bigint, text string"), path).first().restored
    assert pieces.encoded(nothing, path).count() == 0


def test_quality_measures_against_python(spark, docs, nothing):
    line = "one two three four five six seven eight nine"
    texts = [*(t for _, t in TEXTS), line + "\n" + line + "\n\n" + line, "a b c d e f g h " * 4, "# | * x", "x" * 400]
    for text in texts:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines), len(lines) - len(set(lines)), len(inside))
        assert quality.measure(text) == want
    rows = quality.judged(quality.ledger(docs), "v1")
    by = {r.doc_id: r for r in rows.collect()}
    assert by[3].fail_bits == by[4].fail_bits == 1
    got = {r.rule: (r.failed, r.failed_alone) for r in quality.ablation(rows, "v1").collect()}
    failing = [r.fail_bits for r in rows.collect()]
    for rule in quality.RULES:
        bit = 1 << rule.bit
        assert got[rule.name] == (sum(f & bit > 0 for f in failing), sum(f == bit for f in failing))
    assert quality.ledger(nothing).count() == 0


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(13)
    plain = [f"plain{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(300):
        words = rng.sample(plain, 60)
        if i % 5 == 0:
            words[:2] = rng.sample(["nastyone", "nastytwo", "vile", "scummy"], 2)
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, clean[k][1] + " ", "en", "s1", 0) for k in range(20)]
    near = clean[30][1].split()
    near[7] = "other"
    rows += [(2000, " ".join(near * 4), "en", "s2", 0), (2001, " ".join(clean[30][1].split() * 4), "en", "s2", 0), (2002, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixture", "sentencepiece"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    safe = stages["toxicity"](spark, docs, str(tmp_path))
    assert safe.columns == docs.columns
    assert ids(safe) == sorted(r[0] for r in rows if r[0] % 5 or r[0] >= 1000)
    once = stages["exact_dedup"](spark, safe, str(tmp_path))
    # the longer original stays: the copies end in a blank
    dropped = {clean[k][0] for k in range(20)}
    assert ids(once) == sorted(set(ids(safe)) - dropped)
    single = stages["simhash_near_dedup"](spark, once, str(tmp_path))
    left = set(ids(once)) - set(ids(single))
    assert left <= {2000, 2001}
    mixed = stages["source_mixture"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    sizes = Counter()
    taken = Counter()
    for r in single.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.2)
    final = stages["sentencepiece"](spark, mixed, str(tmp_path))
    assert final.count() == mixed.count()
    assert final.where("NOT restored").count() == 0
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(final)


def test_folds_are_those_of_crc32(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", crc32_of().alias("crc")).collect()
    assert all(r.crc == zlib.crc32(str(r.doc_id).encode()) for r in rows)
