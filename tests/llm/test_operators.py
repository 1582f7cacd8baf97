"""Every corpus operator against brute force on small fixtures, with nulls, empties, ties, repeats and clashes."""

import hashlib
import io
import itertools
import random
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from velotrace.llm import common, embedding_dedup, language_id, license_scan, line_dedup, media, packing, quality, sentencepiece, simhash, token_counts

LINE = "This very line of some forty or more characters repeats."
SCHEMA = "doc_id long, text string, lang string, score string, fp string, keys string, n_tokens string, n_lines string"
WORDS = {"en": "the of and that with thing over", "de": "und der die nicht über schön straße", "fr": "être une avec déjà très où ça"}


def texts() -> list[tuple]:
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, "x"), (4, "Word " * 30_000), (5, LINE + "\nown five"), (5, LINE + "\nown five"), (None, LINE + "\nno id"), (6, "12 34 !!"), (7, "a▁b Ünï\x00 çö\U0001f600")]
    rows += [(i, f" {LINE.upper() if i % 2 else LINE}\t\nline {i}\n\n{LINE}") for i in range(10, 16)]
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(300)]
    for i in range(20, 30):
        w = list(base)
        w[i] = "changed"
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "f", "k", "n", "l") for i, t in texts()], SCHEMA)


def pairs_of(df, *cols):
    return sorted(((r[0], *r[1:]) for r in df.select(*cols).collect()), key=str)


def components(ids, linked):
    """Smallest id reachable, by plain search."""
    root = {}
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            for y in linked.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        root[i] = min(seen)
    return root


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    linked = {}
    for a, b in edges:
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    want = {v: r for v, r in components(linked, linked).items() if linked[v] != {v}}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["vertex"]: r["root"] for r in got.collect()} == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ---------------------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs):
    mit = license_scan.KNOWN[0][1]
    british = "Copyright (c) 2001 Some Body\n\n" + mit.replace("sublicense", "sublicence").upper().replace(",", " ,")
    rows = [(1, british), (2, mit + " extra"), (3, "x\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0."), (3, "SPDX-License-Identifier: ISC"), (4, None)]
    got = {(r["doc_id"], r["license_id"], tuple(r["notices"])) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", ()), (2, None, ()), (3, None, ("CC-BY-NC-4.0", "MIT")), (3, "ISC", ("ISC",)), (4, None, ())}
    result = license_scan.scan(docs).collect()
    assert len(result) == docs.count() and all(r["digest"] == license_scan.digest(t) for r, t in zip(sorted(result, key=lambda r: str(r["digest"])), sorted((t for _, t in texts()), key=lambda t: str(license_scan.digest(t))), strict=True))
    assert license_scan.scan(docs.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_best_bounds_is_optimal():
    rng = random.Random(2)
    for n in range(1, 40):
        lengths = [rng.randrange(1, 30) for _ in range(n)]
        cells = [(x, lengths.count(x)) for x in sorted(set(lengths))]
        for k in (1, 2, 3, 5):
            bounds = packing.best_bounds(cells, k)
            tops = sorted(set(lengths))
            least = min(padding(lengths, (*c, tops[-1])) for r in range(min(k, len(tops))) for c in itertools.combinations(tops[:-1], r))
            assert padding(lengths, bounds) == least and len(bounds) <= k


def test_packing(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)
    rows = packing.pack(docs, n_buckets=4, token_budget=700).collect()
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts())
    assert sorted(r["n_tokens"] for r in rows) == words
    for (bucket, length), group in itertools.groupby(sorted(rows, key=lambda r: r["bucket"]), lambda r: (r["bucket"], r["bucket_len"])):
        group = list(group)
        room = max(1, 700 // max(length, 1))
        assert sorted((r["batch_id"], r["slot"]) for r in group) == [(i // room, i % room) for i in range(len(group))], bucket
        assert all(r["n_tokens"] <= length for r in group)
    assert packing.pack(docs.limit(0)).count() == 0
    none = packing.pack(docs, length=F.when(F.col("doc_id") > 5, F.col("doc_id"))).collect()
    assert sorted(r["n_tokens"] for r in none) == sorted(i if i is not None and i > 5 else 0 for i, _ in texts())
    with pytest.raises(ValueError):
        packing.pack(docs, length=-F.lit(1))


def test_packing_is_exact_at_any_length(spark):
    """Lengths far apart and far above any table of cells; the least padding is found by trying all bounds."""
    rng = random.Random(3)
    lengths = [40_000 + rng.randrange(60) for _ in range(25)] + [rng.randrange(10**9) for _ in range(8)] + [10**12, 10**12 + 1, 10**12 + 2, 10**12 + 2]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.pack(df, n_buckets=3, length=F.col("n")).collect()
    tops = sorted(set(lengths))
    least = min(padding(lengths, (*c, tops[-1])) for r in range(3) for c in itertools.combinations(tops[:-1], r))
    assert sum(r["bucket_len"] - r["n_tokens"] for r in rows) == least


# 3 ---------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_and_groups(spark, docs):
    short = [(i, t) for i, t in texts() if t is None or len(t) < 20_000]
    for _, t in short:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    fps = {}
    for i, t in texts():
        if i is not None:
            fps[i] = simhash.fingerprint(t)
    linked = {a: [b for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3] for a in fps}
    want = components(fps, linked)
    for bucket in (256, 2):
        got = simhash.near_duplicate_groups(docs, max_bucket=bucket).collect()
        assert len(got) == docs.count()
        for r in got:
            if r["doc_id"] is not None:
                assert r["component_id"] == want[r["doc_id"]] and r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [256, 3, 1])
def test_links_have_the_components_of_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(15):
            fp = centre
            for _ in range(rng.randrange(5)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    want = components(fps, {a: [b for b in fps if (a ^ b).bit_count() <= 3] for a in fps})
    found = simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), bucket).collect()
    linked = {}
    for r in found:
        a, b = r["a"] % 2**64, r["b"] % 2**64
        assert (a ^ b).bit_count() <= 3
        linked.setdefault(a, []).append(b)
        linked.setdefault(b, []).append(a)
    assert components(fps, linked) == want


# 4 ---------------------------------------------------------------------------------------------------------------


def test_line_dedup(docs):
    blank, lines = " \t\n\x0b\x0c\r", {}
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line.strip(blank))
    for i, t in texts():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                lines.setdefault(key(line), set()).add(i)
    bad = {k: max(v) for k, v in lines.items() if len(v) >= 5}
    want = []
    for i, t in texts():
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if i is None or key(x) not in bad or bad[key(x)] == i]
        want.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(docs).select("doc_id", "kept_text", "n_lines_1", "n_dropped").collect()]
    assert bad and sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_key(spark):
    lines = ["\x0b ÄBC x\t", "ÉABZ", "", "İ A", " A"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(line_dedup.line_key(F.col("l"))).collect()]
    assert got == ["Äbc x", "Éabz", "", "İ a", " a"]


# 5, 7 ------------------------------------------------------------------------------------------------------------


def slow_viterbi(v, text):
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(end):
            p = v.pieces.get(text[start:end])
            if p and best[start] + p[1] > best[end]:
                best[end], back[end] = best[start] + p[1], (start, [p[0]])
        if text[end - 1] not in v.pieces and best[end - 1] + v.unknown > best[end]:
            best[end], back[end] = best[end - 1] + v.unknown, (end - 1, [v.byte_ids[b] for b in text[end - 1].encode()])
    ids, at = [], len(text)
    while at:
        at, own = back[at]
        ids = own + ids
    return ids, best[-1]


def test_pieces_and_counts(docs):
    v = sentencepiece.load()
    coded = sentencepiece.encode(docs)
    rows = sentencepiece.decode(coded).collect()
    assert len(rows) == docs.count()
    counts = sorted((r["n_tokens"] for r in token_counts.token_counts(docs).collect()))
    assert counts == sorted(r["n_pieces"] for r in rows)
    back = sorted(r["text"] for r in rows)
    assert back == sorted((t or "").replace("▁", " ") for _, t in texts())
    for text in ("", "the quick", "a▁b\nÜnï\x00 çö\U0001f600  two", "x" * 60, LINE):
        ids, _, score = sentencepiece._encoder(v).encode([text])[0]
        want, best = slow_viterbi(v, "▁" + text.replace(" ", "▁")) if text else ([], 0.0)
        assert ids.tolist() == want and score == pytest.approx(best)
    assert sentencepiece.encode(docs.limit(0)).count() == 0 == token_counts.token_counts(docs.limit(0)).count()


def test_decoding_agrees_with_the_library():
    spm = pytest.importorskip("sentencepiece")
    m = spm.SentencePieceProcessor(model_file=sentencepiece.DEFAULT_MODEL)
    v = sentencepiece.load()
    for text in ("Hello wide world", "déjà vu\nnew  line", "日本語 \U0001f600"):
        ids = m.encode(text)
        assert sentencepiece.decode_ids(v.raw, ids) == m.decode(ids) == text


# 6 ---------------------------------------------------------------------------------------------------------------


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(12):
            c = rng.standard_normal(64)
            for _ in range(8):
                rows.append((i, (c + rng.standard_normal(64) * rng.choice([0.05, 0.3, 0.4])).tolist(), label))
                i += 1
    rows += [(i, rows[0][1], 1), (i + 1, rows[0][1], None), (i + 2, None, 1), (i + 3, [0.0] * 64, 1), (i + 4, [float("nan")] * 64, 1), (i + 5, [1.0, None], 1), (i + 6, [], 2), (i + 7, [1.0, 2.0], 1), (i + 8, [2.0, 4.0], 1), (i + 9, [-0.0, 1.0], 2), (i + 10, [0.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, rid string")

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        v = np.asarray(v, np.float32).astype(float)
        return v / np.linalg.norm(v) if v.any() else None

    units = {r[0]: (unit(r[1]), r[2]) for r in rows}
    linked = {a: [b for b in units if a != b and units[a][1] is not None and units[a][1] == units[b][1] and units[a][0] is not None and units[b][0] is not None and len(units[a][0]) == len(units[b][0]) and units[a][0] @ units[b][0] >= 0.93] for a in units}
    want = components(units, linked)
    got = embedding_dedup.near_duplicates(df).collect()
    for blocks in (1 << 18, 640):  # one block a label, and many
        got = embedding_dedup.near_duplicates(df, block_values=blocks).collect()
        assert len(got) == len(rows) and sum(map(len, linked.values())) > 300
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(linked[i]), want[i], want[i] == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_scale_and_hubs(spark):
    """Double vectors of extreme scale, and a label of one crowd: every vector links with every other."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base * 10.0 ** (40 * (i % 11) - 200)).tolist(), 1) for i in range(11)]
    rows += [(100 + i, (base + rng.standard_normal(16) * 0.02).tolist(), 2) for i in range(300)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block_values=800).collect()}
    assert all(got[i]["n_links"] == 10 and got[i]["component_id"] == 0 for i in range(11))
    assert all(got[i]["n_links"] == 299 and got[i]["component_id"] == 100 for i in range(100, 400))


def test_estimates_and_bounds():
    """Estimates are unbiased over rotations, the certain bound holds for all pairs and rules most far pairs out."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 64))
    b = a + rng.standard_normal((4000, 64)) * rng.choice([0.1, 0.6, 3.0], (4000, 1))
    a, b = (embedding_dedup.unit_vectors(x @ embedding_dedup.rotation(64).T) for x in (a, b))
    packed, factor = embedding_dedup.codes(a)
    truth = (a * b).sum(1)
    inner = (np.where(np.unpackbits(packed, axis=1) == 1, b, -b)).sum(1) / 8
    assert abs((inner / factor - truth).mean()) < 0.01
    part = slice(0, 500)
    sure = embedding_dedup.upper_bounds(packed[part], factor[part], b[part])
    likely = embedding_dedup.upper_bounds(packed[part], factor[part], b[part], eps=5.0)
    cosines = a[part] @ b[part].T
    assert (cosines <= sure + 1e-4).all() and (cosines <= likely + 1e-4).mean() > 0.999
    assert (sure[cosines < 0.3] >= 0.93).mean() < 0.01


# 8 ---------------------------------------------------------------------------------------------------------------


def test_gru_gradients_are_right():
    rng = np.random.default_rng(1)
    model = language_id.ByteGru.fresh(["a", "b"], 3, rng)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = rng.integers(97, 100, (5, 4)), rng.integers(0, 2, 4)
    _, g = model.gradients(x, y)
    for name, w in model.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape) if name[0] != "E" else (int(x[2, 0]), int(rng.integers(9)))
            ends = []
            for d in (1e-5, -1e-5):
                w[at] += d
                ends.append(model.gradients(x, y)[0])
                w[at] -= d
            assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-5), name


def slow_language(model, text):
    """Mean probabilities of all positions, one byte and one direction after the other."""
    size, context = language_id.WINDOW, language_id.CONTEXT
    raw = text.lower().encode()
    total, n = 0.0, 0
    for start in range(0, max(1, len(raw)), size):
        whole = b" " * context + raw + b" " * (size + context)
        window = whole[start : start + size + 2 * context]
        states = {}
        for d in "fb":
            e, u = model.weights["E" + d].astype(float), model.weights["U" + d].astype(float)
            h = u.shape[0]
            s, out = np.zeros(h), {}
            for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
                a = e[window[t]]
                gate = np.clip(a[: 2 * h] + s @ u[:, : 2 * h] + 0.5, 0, 1)
                new = np.clip(a[2 * h :] + (gate[h:] * s) @ u[:, 2 * h :], -1, 1)
                s = gate[:h] * s + (1 - gate[:h]) * new
                out[t] = s
            states[d] = out
        for t in range(context, context + min(size, len(raw) - start)):
            o = np.concatenate([states["f"][t], states["b"][t]]) @ model.weights["V"] + model.weights["c"]
            p = np.exp(o - o.max())
            total, n = total + p / p.sum(), n + 1
    return total / n


def test_language_reads_all_bytes():
    """Whole texts against a plain recount: long, unbroken and many-byte texts, windows that cut characters, every batch alike."""
    model = language_id.ByteGru.fresh(["a", "b", "c"], 5, np.random.default_rng(1))
    texts = ["x", "Zwei 12 Wörter!", "été " * 60, "漢字" * 200, "y" * 191, "y" * 192, "y" * 193, "สวัสดี" * 70]
    langs, scores = language_id.label(model, [*texts, "", None, "² ½ ① 12", "Ⅷ"])
    for i, text in enumerate(texts):
        p = slow_language(model, text)
        assert langs[i] == model.languages[int(p.argmax())] and scores[i] == pytest.approx(p.max(), abs=1e-4)
    assert langs[len(texts) :] == ["und"] * 4 and not scores[len(texts) :].any()
    # a change anywhere in a text can change its score
    long = "a b c d " * 100
    assert language_id.label(model, [long])[1][0] != language_id.label(model, [long[:700] + "q" + long[701:]])[1][0]


def test_language_id(spark, docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=30)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, "doc_id", "text", "lang", ~common.held_out("doc_id"), sample_docs=30, steps=150, batch=64)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    odd = language_id.identify(docs, model).collect()
    assert len(odd) == docs.count()
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {0, 1, 2, 6} and all(r["score"] == 0 for r in odd if r["lang_pred"] == "und")
    none = language_id.train(df.where("lang IS NULL"), "doc_id", "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
    few = language_id.train(df, "doc_id", "text", "lang", F.lit(True), max_languages=2, steps=2)
    assert few.languages == ["de", "en"]


# 9 ---------------------------------------------------------------------------------------------------------------


def test_media(docs):
    want = {}
    for _, t in texts():
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[hashlib.sha256(payload).hexdigest()] = (len(raw), len(payload), zlib.crc32(payload[-64:]))
    rows = media.media_digests(docs).collect()
    assert len(rows) == docs.count() and {r["payload_sha256"]: (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in rows} == want
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) == len(want)
    stored = media.media_columns(docs).where("doc_id = 3").first()
    with wave.open(io.BytesIO(bytes(stored["media"]))) as f:
        assert f.readframes(99) == b"x" + bytes(63)
    assert media.media_digests(docs.limit(0)).count() == 0


def test_spectral_pairs_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 10 * t / media.FRAME)).astype(np.uint8).tobytes()
    times, codes = media.spectral_pairs(tone)
    assert set((codes // 4096).tolist()) == {10} and (np.diff(times) >= 0).all() and len(media.spectral_pairs(bytes([128]) * 640)[0]) == 0


# 10 --------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    rows, marks = [], []
    for i in range(300):
        good = i % 3 != 0
        w = [word() for _ in range(40)]
        rows.append((i, " ".join(w) + "." if good else (" ".join(x + "###" for x in w) if i % 2 else " ".join([w[0]] * 40))))
        marks.append((i, int(good)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(df, labels, ~common.held_out("doc_id"))
    got = {r["doc_id"]: r for r in quality.classify(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == dict(marks)[i] for i in held]) > 0.95
    odd = quality.classify(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    blank = quality.train(df, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in quality.classify(docs, blank).collect()} == {1}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_held_out(spark):
    got = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", common.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_ratios_and_dual_against_plain_solvers():
    """Log-count ratios by hand; the hinge fit reaches the optimum: no gap to its own dual, and none better by plain descent."""
    counts = np.array([[3, 0, 1], [1, 2, 1]], float)
    p, q = (counts[1] + 1) / (counts[1] + 1).sum(), (counts[0] + 1) / (counts[0] + 1).sum()
    assert np.allclose(quality.log_count_ratios(counts), np.log(p / q))
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.where(np.array([r.sum() for r in rows]) > 156, 1.0, -1.0)
    ratios, cost = rng.standard_normal(40), np.full(60, 0.5)
    w, bias = quality.dual_coordinate_descent(rows, y, ratios, cost, epochs=300)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 40] = 1
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best, v = np.inf, np.zeros(41)
    for step in range(1, 20_001):
        v = v - (v - (cost * y * (y * (x @ v) < 1)) @ x) / step
        best = min(best, primal(v))
    assert primal(np.append(w, bias)) <= best + 1e-3


def slow_grams(text):
    """N-grams of a text as plain sets."""
    raw, words = text.encode(), text.lower().split()
    signs = [1 if i and w == words[i - 1] else 2 if i > 1 and w == words[i - 2] else 0 for i, w in enumerate(words)]
    grams = {raw[i : i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1)} | {("w", w) for w in words} | {("w", *p) for p in itertools.pairwise(words)}
    return grams | {("s", *signs[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(signs) - n + 1)}


def test_indicators_are_those_of_all_ngrams(monkeypatch):
    """As many buckets as n-grams but for collisions, and texts of equal n-grams have equal indicators, in blocks too."""
    rng = random.Random(4)
    for text in ("", "a", "ab", "Ab ab aB x ab x", "ü é", " ".join(rng.choice("abcde") * rng.randrange(1, 4) for _ in range(400))):
        whole, want = quality.indicators(text), len(slow_grams(text))
        assert want - 3 <= len(whole) <= want
        monkeypatch.setattr(quality, "_BLOCK", 50)
        assert np.array_equal(whole, quality.indicators(text))
        monkeypatch.undo()


def test_quality_sample_is_not_flooded_by_copies(spark):
    """Thousands of copies of one text neither fill the sample nor come in or stay out as one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    rows, marks = [], []
    for i in range(400):
        good = i % 2
        rows.append((i, " ".join(word() + ("" if good else "###") for _ in range(40))))
        marks.append((i, good))
    for line in ("same line again", "other words here"):
        copies = [(1000 + i, line) for i in range(4000)]
        df = spark.createDataFrame(rows + copies, "doc_id long, text string")
        labels = spark.createDataFrame(marks + [(i, 1) for i, _ in copies], "doc_id long, quality int")
        model = quality.train(df, labels, ~common.held_out("doc_id"), sample_docs=300)
        held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
        scores = model.scores([rows[i][1] for i in held])
        assert np.mean((scores >= quality.CUT) == [i % 2 for i in held]) > 0.95


# 1, 5, 7, 9 against plain forms ------------------------------------------------------------------------------------


def test_license_digest_against_a_plain_form():
    """The canonical form by characters alone, for texts whose notice lines are given."""
    mit = license_scan.KNOWN[0][1]
    for text, notices in ((mit, 0), ("Copyright (c) 2020 A. Holder\n\n" + mit, 1), ("© 2001-2003 X\nAll rights reserved.\n" + mit.upper(), 2)):
        lines = text.lower().splitlines()[notices:]
        plain = "".join(c if c.isalnum() else " " for c in "\n".join(lines)).split()
        plain = [license_scan.SPELLINGS.get(w, w) for w in plain]
        assert license_scan.digest(text) == hashlib.sha256(" ".join(plain).encode()).hexdigest()


def test_unbroken_text_in_bounded_memory():
    """Half a million characters without a blank: equal counts by both operators, small paths, memory that does not grow with the text."""
    import tracemalloc

    v = sentencepiece.load()
    trie = token_counts.CountTrie(v)
    rng = random.Random(6)
    for word in ("ab" * 40_000, "".join(rng.choice("abcdeé漢") for _ in range(70_000)), "é" * 300):
        assert trie.long_count(word) == len(sentencepiece._encoder(v).viterbi(word))
    assert trie.walk(["abc", "abcd"]) == [trie.long_count("abc"), trie.long_count("abcd")]
    tracemalloc.start()
    trie.long_count("abcdefgh" * 60_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_spectral_pairs_against_a_plain_transform():
    rng = np.random.default_rng(7)
    samples = rng.integers(0, 256, 64 * 9).astype(np.uint8)
    n, hop = media.FRAME, media.HOP
    k, t = np.arange(1, n // 2 + 1), np.arange(n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1))
    peaks = []
    for start in range(0, len(samples) - n + 1, hop):
        x = (samples[start : start + n].astype(float) - 128) * window
        power = np.hypot((x * np.cos(2 * np.pi * np.outer(k, t) / n)).sum(1), (x * np.sin(2 * np.pi * np.outer(k, t) / n)).sum(1))
        peaks.append(int(k[np.round(power, 3).argmax()]))
    want = sorted((i, peaks[i] * 4096 + peaks[i + d] * 16 + d) for d in range(1, media.REACH + 1) for i in range(len(peaks) - d))
    times, codes = media.spectral_pairs(samples.tobytes())
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == want


# extra columns ------------------------------------------------------------------------------------------------------


def test_line_dedup_keeps_columns_of_any_name(docs):
    """Columns that clash with its own names, in any case, keep their values; new ones take free names."""
    names = ["doc", "t", "Gone", "lines", "_doc", "_t1", "kept_text", "N_LINES", "n_dropped", "pos", "a.b"]
    wide = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    got = line_dedup.drop_repeated_lines(wide)
    assert got.columns == [*wide.columns, "kept_text_1", "n_lines_1", "n_dropped_1"]
    for r in got.collect():
        assert all(r[n] == f"{n}-{'-' if r['doc_id'] is None else r['doc_id']}" for n in names)
    plain = line_dedup.drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", "kept_text").collect()
    assert sorted(map(tuple, got.select("doc_id", "kept_text_1").collect()), key=str) == sorted(map(tuple, plain), key=str)


def test_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("64m", str(2 << 20)), ("67108864b", str(2 << 20)), ("1m", "1m"), ("4096", "4096")):
            spark.conf.set(name, given)
            common.bounded_batches(spark)
            assert spark.conf.get(name) in (want, want + "b")
    finally:
        spark.conf.set(name, before)
