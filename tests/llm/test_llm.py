"""The training-data operators against brute force, round trips and planted cases."""

import hashlib
import math
import random
import textwrap
import tracemalloc
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from foliant.llm import bpe_fst, learn, licenses, media_gif, near_dedup, packing, quality, substring_dedup, token_store, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, rid string, lang string"
WORDS = [f"w{k}" for k in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    base, passage = prose(rnd, 200), prose(rnd, 60)
    near = base.split()
    near[50] = "changed"
    rows = [(k, prose(rnd, rnd.randrange(1, 300))) for k in range(40)]
    rows += [(100, base), (101, base), (102, " ".join(near)), (103, f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}"), (104, f"{passage} {prose(rnd, 30)}")]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "word " * 5000), (204, "Ä ß中\U0001f600 l'été\n\nReleased under the MIT License."), (0, rows[0][1]), (None, "no id here")]
    return spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def licenses_by_hand(text, templates=licenses.TEMPLATES):
    """(unit, first word, licence) of every match."""
    def dice(words, own):
        a = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}
        return 2.0 * len(a & own) / (len(a) + len(own)) if a else 0.0

    words_of = lambda u: regex.findall(r"[\p{L}\p{N}]+", u.lower())
    holds = lambda u: any(k in u.lower() for k in licenses.KEYS)
    sets = {n: set(licenses.bigrams_of(t)) for n, t in templates.items()}
    out = []
    for unit, part in enumerate([text.replace("\n", " "), *text.split("\n")]):
        score, name = min(((-dice(words_of(part), own), n) for n, own in sets.items()), default=(0, ""))
        if score <= -licenses.THRESHOLD and holds(part):
            out.append((unit, None, name))
    words = words_of(text)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for n, t in templates.items():
        size = len(words_of(t))
        for s in {max(0, k - place) for gram, place in licenses.anchors(t, licenses.KEYS) for k, g in enumerate(grams) if g == gram}:
            if dice(words[s : s + size], sets[n]) >= licenses.THRESHOLD:
                out.append((-1, s, n))
    return out


def wrapped(text, width=80):
    return "\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_licenses(spark, docs, empty):
    rnd = random.Random(12)
    held = {n: licenses.TEMPLATES[n] for n in ("MIT-text", "ISC-text", "BSD-3-Clause-text", "Apache-2.0-text", "GPL-3.0-notice")}
    rows = [(k, f"{prose(rnd, 300)}\n\n{wrapped(t)}\n\n{prose(rnd, 200)}") for k, t in enumerate(held.values())]
    rows += [(10, "We thank all readers for their help. Released under the MIT License. Yours."), (11, "Released under the MIT License.\n" * 3), (11, "Released under the MIT License.\n" * 3), (12, "license " * 3000), (13, "license"), (None, "Licensed under CC BY 4.0.")]
    frame = docs.select("doc_id", "text", F.lit("clash").alias("unit"), F.lit("clash").alias("b")).unionAll(spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, unit string, b string"))
    want = [(r["doc_id"], *x) for r in frame.collect() for x in licenses_by_hand(r["text"] or "")]
    got = [(r["doc_id"], r["unit"], r["first_word"], r["license"]) for r in licenses.scan(frame).collect()]
    same(got, want)
    for k, name in enumerate(held):  # whole licences, wrapped, in the middle of other prose
        assert (k, -1, 300, name) in got
    assert (10, -1, 7, "MIT-line") in got and (204, 3, None, "MIT-line") in got
    assert licenses.scan(empty).count() == 0
    own = licenses.scan(spark.createDataFrame([(1, "some words\nalpha beta gamma delta epsilon\nx")], "doc_id long, text string"), {"own": "Alpha beta gamma, delta epsilon"}).collect()
    assert {(r["unit"], r["license"], r["dice"]) for r in own} == {(2, "own", 1.0), (-1, "own", 1.0)}


MIT_FILE = """MIT License

Copyright (c) 2026 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_whole_license_texts(spark):
    names = sorted(n for n in licenses.TEMPLATES if n.endswith("-text"))
    assert {"Apache-2.0-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-3.0-text", "ISC-text", "MIT-text", "Zlib-text"} <= set(names)
    assert "must not be misrepresented" in licenses.TEMPLATES["Zlib-text"] and "ARISING OUT OF" in " ".join(licenses.TEMPLATES["ISC-text"].split())
    rows = [(-1, MIT_FILE)] + [(k, "Copyright (c) 2026 A. Holder\n\n" + licenses.TEMPLATES[n]) for k, n in enumerate(names)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("unit = 0").collect()
    same([(r["doc_id"], r["license"]) for r in got], [(-1, "MIT-text"), *enumerate(names)])


def test_gif_round_trip(docs, texts, empty):
    rows = media_gif.payload_rows(docs, keep_media=True).collect()
    want = []
    for i, t in texts:
        raw = t.encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    same([tuple(r)[:5] for r in rows], want)
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] for r in rows)
    assert media_gif.payload_rows(empty).count() == 0


def test_gif_of_long_texts_and_large_canvases(spark):
    long = "0123456789 ABCDEF " * 90_000  # more than two frames
    rows = media_gif.payload_rows(spark.createDataFrame([(1, long, "clash"), (1, long, "clash")], "doc_id long, text string, media string"), keep_media=True).collect()
    assert [r["payload_sha256"] for r in rows] == [hashlib.sha256((long + " " * (-len(long) % 192)).encode()).hexdigest()] * 2
    frames = media_gif.frame_rows(spark.createDataFrame([(1, bytes(rows[0]["media"])), (2, b"GIF89a" + b"\xff\xff\xff\xff" + bytes(9))], "id long, media binary"), "id", "media").collect()
    assert [(r["frame"], r["start_cs"]) for r in frames if r["media_id"] == 1] == [(0, 0), (1, 10), (2, 20)]
    assert [r["reason"] for r in frames if r["media_id"] == 2] == ["canvas too large"]


def test_gif_decoder_rules(spark):
    import struct

    def frame(samples, w, h, left=0, top=0, disposal=0, transparent=None, least=2):
        clear = 1 << least
        codes = [clear]
        for k, s in enumerate(samples):  # a clear code after each sample keeps the width
            codes += [s, clear]
        codes[-1] = clear + 1
        data = media_gif._bits(np.array(codes), np.full(len(codes), least + 1))
        control = struct.pack("<BHB", disposal << 2 | (transparent is not None), 7, transparent or 0)
        return b"\x21\xf9\x04" + control + b"\0\x2c" + struct.pack("<HHHHB", left, top, w, h, 0) + bytes((least,)) + media_gif._blocks(data)

    palette = bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x81, 0, 0) + palette
    gif = head + frame([1, 1], 2, 1) + frame([2, 3], 2, 1, transparent=3, disposal=2) + frame([3], 1, 1, left=1, disposal=3) + frame([2], 1, 1, left=0) + b"\x3b"
    frames = list(media_gif.decode_gif(gif))
    colours = [[tuple(map(int, p)) for p in f.canvas.reshape(-1, 4)] for f in frames]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert colours == [[red, red], [green, red], [none, blue], [green, none]]
    assert [f.start for f in frames] == [0, 7, 14, 21]
    rows = media_gif.frame_rows(spark.createDataFrame([(1, gif), (2, b"no gif"), (3, None)], "id long, media binary"), "id", "media").collect()
    assert Counter(r["media_id"] for r in rows) == {1: 4, 2: 1, 3: 1} and all(r["reason"] for r in rows if r["media_id"] > 1)
    samples = bytes(random.Random(3).randrange(256) for _ in range(192 * 300))
    assert media_gif.lzw_decode(media_gif.lzw_encode(samples), 8, len(samples)) == samples


def test_near_dedup(docs, texts, empty):
    sets = {}
    for i, t in texts:
        sets.setdefault(i, near_dedup.shingles(t))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs).collect() if r["doc_id"] is not None}
    assert got == set(root.items())
    assert root[101] == root[102] == 100 and root[201] == root[202] == 200
    assert near_dedup.classes(empty).count() == 0
    assert {r["doc_id"] for r in near_dedup.keep_one(docs).collect() if r["doc_id"] is not None} == set(root.values())


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(5)
    e = np.sort(rnd.integers(1, 1 << 62, 400).astype(np.uint64))
    a, b = (e[:300], rnd.integers(1, 6, 300)), (e[100:], rnd.integers(1, 6, 300))
    s = near_dedup.signatures([a, b], 2048)
    assert abs((s[0] == s[1]).mean() - near_dedup.similarity(a, b)) < 0.05


def test_near_dedup_joins_a_chain(spark):
    rnd = random.Random(8)
    words, rows = prose(rnd, 300).split(), []
    for k in range(12):  # each differs from the one before in few words, the ends in many
        words = list(words)
        words[20 * k] = f"new{k}"
        words[20 * k + 7] = f"other{k}"
        rows.append((k, " ".join(words), "", ""))
    got = near_dedup.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["class_id"] for r in got} == {0}


def test_keep_one_keeps_one_row_a_class(spark):
    rnd = random.Random(5)
    a, b, c, d, e = (prose(rnd, 120) for _ in range(5))
    rows = [(7, a), (7, a), (None, b), (None, b), (1, c), (2, c), (2, d), (None, a), (9, e)]
    frame = spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], SCHEMA).repartition(3)
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [(7, a), (None, b), (1, c), (2, d), (9, e)])
    cleaned = substring_dedup.clean(near_dedup.staged(kept, "kept")).collect()
    same([(r["doc_id"], r["text"]) for r in cleaned], [(7, a), (None, b), (1, c), (2, d), (9, e)])


def test_token_store(spark, docs, texts, empty):
    layout = token_store.Layout(tokens.vocabulary("word_bpe_49k.json"), False, 1)
    path = token_store.write_store(docs, layout)
    ids = sorted(((i is not None, i or 0, np.array([*by_library("word_bpe_49k.json", t), 1], "<u4")) for i, t in texts), key=lambda x: x[:2])
    got = token_store.read_store(spark, path, layout).orderBy("start").collect()
    at = 0
    for r, (_, i, own) in zip(got, ids, strict=True):
        assert (r["start"], r["doc_id"] or 0) == (at, i)
        at += r["n_tokens"]
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(i if known else None, len(o), zlib.crc32(o.tobytes())) for known, i, o in ids])
    assert token_store.manifest_breaks(spark, path).count() == 0
    back = {(r["doc_id"], tuple(r["ids"])) for r in token_store.read_ids(spark, path, layout).collect()}
    assert back == {(i if known else None, tuple(o.tolist())) for known, i, o in ids}
    stored = [x for r in token_store.packs_of(spark, path).collect() for k in r["held"] for x in [r["addrs"][16 * k : 16 * k + 16]]]
    assert len(stored) == len(set(stored))  # each chunk once
    assert token_store.read_store(spark, token_store.write_store(empty, layout), layout).count() == 0


def test_token_store_checks_its_manifest(spark, docs, tmp_path):
    layout = token_store.Layout(tokens.vocabulary("word_bpe_49k.json"), False, 1)
    path = token_store.write_store(docs, layout)
    packs, manifest = token_store.packs_of(spark, path), spark.read.parquet(f"{path}/manifest")
    lost = packs.where("array_contains(held, 0) and doc_id is not null").orderBy("doc_id").first()
    for name, changed in (("missing", packs.where(f"rid <> {lost['rid']}")), ("extra", packs.unionByName(packs.where("doc_id = 201")))):
        changed.write.parquet(f"{tmp_path}/{name}/packs")
        manifest.write.parquet(f"{tmp_path}/{name}/manifest")
        with pytest.raises(ValueError, match="do not match the manifest"):
            token_store.read_store(spark, f"{tmp_path}/{name}", layout)


@cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


def by_library(name, text):
    return library(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "keeps_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_units_are_encoded_as_the_library_does(name, keeps_space):
    rnd = random.Random(3)
    letters = "ab Z.\n  \t,'!-_<|>1\u00e9\u00df\u4e2d\U0001f600\u0130\u03a3\u0301K\u212a  \r\x0b\x1c\u3000\x85\u01c5"
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "don't", "it'LL", "Stra\u00dfe", "\u039f\u03a3", "\u0130x", "na\u00efve,", "(a)", "a-b", "x\n\ny", " lead", "trail ", "a\nb", "A.\nB!", "...", "foo)\n(bar", "\ufb01x", "1,000"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    texts += [between.join(rnd.choice(bits) for _ in range(rnd.randrange(1, 8))) for between in (" ", "\n", "") for _ in range(500)]
    encoder = tokens.UnitEncoder(tokens.vocabulary(name), keeps_space, most=2000)  # the memo begins anew several times
    for first in range(0, len(texts), 300):
        part = texts[first : first + 300]
        ids, ends = encoder.encode_batch(part)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [by_library(name, t) for t in part]
    assert encoder.encode_batch([])[0].tolist() == [] and encoder.encode_all([""]) == [b""]


@pytest.mark.parametrize(("name", "keeps_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_are_encoded_as_the_library_does(name, keeps_space):
    from tokenizers import Tokenizer

    path = tokens.vocabulary(name)
    library, encoder = Tokenizer.from_file(path), tokens.UnitEncoder(path, keeps_space)
    parts = ["hello <|endoftext|> world", "<|endoftext|>", "x<|startoftext|>y", "a <|ENDOFTEXT|> b", "\u00c4 <|EndOfText|>", "a <| b |> <|endoftext", "two\n<|endoftext|>\nlines", "<|endoftext|><|endoftext|>", "plain text, twice", ""]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in parts]
    assert encoder.encode_all(parts) == want
    assert [encoder.encode(t) for t in parts] == want


def test_chunks_are_cut_by_content():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 49000, 9000).astype("<u4"), rnd.integers(0, 49000, 500).astype("<u4")

    def ends(parts):
        ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        points = token_store.cut_points(ids)
        return [token_store.chunk_ends(points[(points >= x) & (points < y)].tolist(), int(x), int(y)) for x, y in zip(bounds, bounds[1:], strict=False)]

    alone = ends([a])[0]
    assert ends([b, a, b[:1]])[1] == alone and alone[-1] == 9000  # whatever stands before it
    sizes = np.diff([0, *alone])
    assert sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
    moved = ends([np.concatenate([b[:100], a])])[0]
    assert len({x - 100 for x in moved} & set(alone)) > 0.8 * len(alone)  # an insertion moves few cuts
    assert ends([b[:0], b[:1]]) == [[0], [1]]


def test_crc_of_parts():
    data = random.Random(0).randbytes(5000)
    assert token_store.crc32_joined([(zlib.crc32(data[a:b]), b - a) for a, b in ((0, 0), (0, 17), (17, 4000), (4000, 5000))]) == zlib.crc32(data)


def labelled(rnd, n):
    rows = []
    for k in range(n):
        toxic, good = k % 5 == 0, k % 2
        words = [rnd.choice(WORDS) if good else rnd.choice(WORDS) + "###" for _ in range(80)]
        if toxic:
            words[10:10] = ["zorgish", "idiot"]
            words[50:50] = ["zorgling"]
        rows.append((k, " ".join(words), good, int(toxic)))
    return rows


def test_classifiers_on_held_out_rows(spark, empty):
    rows = labelled(random.Random(4), 600)
    docs = spark.createDataFrame([(i, t, "x", "en") for i, t, _, _ in rows] + [(9000, None, "x", "en"), (9001, "", "x", "en")], SCHEMA)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    for module, at in ((quality, 2), (toxicity, 3)):
        model = module.train(docs, labels)
        got = {r["doc_id"]: r for r in module.score(docs, model).collect()}
        held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
        assert all(got[r[0]]["held_out"] for r in held) and len(got) == 602
        assert np.mean([got[r[0]]["predicted"] == r[at] for r in held]) > 0.97
        assert all(0 <= r["score"] <= 1 for r in got.values())
        none = module.train(empty, labels)
        assert module.score(docs, none).count() == 602 and module.score(empty, model).count() == 0


def test_grammar_context():
    g = toxicity.Grammar(toxicity.learn_lexicon([]), np.array([1.0, 1.0, 0.0, -4.0]))
    best = lambda text: max(s for s, _ in g.clauses(text))
    assert best("you idiot") > best("an idiot") > best("someone said idiot") > best("she never said idiot")
    assert g.clauses("a plain sentence about you") == []
    score = lambda text: g.scores([text])[0]
    for toxic in ("I will kill you", "You are an idiot.", "pathetic loser", "An idiot came. Then another moron came.", "you stupid, worthless clown"):
        assert score(toxic) > 0.5, toxic
    for clean in ("a book about a stupid idea", "idiot", "they kill the process", "It hurt. You came.", "she said they called him a fool", "they never hurt you", "", "Kill it! You can restart."):
        assert score(clean) < 0.5, clean


def test_grammar_of_composed_words():
    g = toxicity.Grammar(toxicity.learn_lexicon([]), np.array([1.0, 1.0, 0.0, -4.0]))
    total = lambda text: round(sum(s for s, _ in g.clauses(text)), 6)
    assert total("a fool") == 0.3 and total("fool you") == 3.0 and total("a fool it is you") == 0.3
    assert total("he is a big old fool") == 0.3  # five words on
    assert total("a fool. a moron") == 6.0  # a second insult sets the first one free, over clauses
    assert total("kill him") == 5.0 and total("kill") == 0.1 and total("kill the old big him") == 0.1 and total("kill. him") == 0.1
    assert total("not kill him") == 2.0 and total("said: kill him") == 5.0 and total("said kill him") == 2.5
    assert len(g.machine.states) < 400


def test_packing(spark, docs, empty):
    name = "byte_bpe_50k.json"
    more = spark.createDataFrame([(300, "<|endoftext|> again <|endoftext|>", "", ""), (300, "word " * 400, "", ""), (300, "word " * 400, "", "")], SCHEMA)
    frame, want = docs.unionAll(more), Counter()
    for r in frame.collect():
        ids = [*by_library(name, r["text"] or ""), 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = packing.pack(frame, tokens.vocabulary(name), 2, 64).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    room = {}
    for r in rows:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(room) <= -(-sum(r["length"] for r in rows) // 64) * 1.02 + 2
    assert packing.pack(empty, tokens.vocabulary(name), 2).count() == 0


def test_plan_is_tight():
    rnd = random.Random(6)
    counts = Counter(rnd.randrange(1, 1024) for _ in range(20_000))
    planned = packing.plan(counts, 1024)
    used = 1 + max(int(x[-1, 1]) for x in planned.values()) + 50
    assert used <= -(-sum(n * c for n, c in counts.items()) // 1024) * 1.02 + 50


def test_bpe_against_tiktoken(docs, texts, empty):
    import tiktoken

    path = tokens.vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = bpe_fst.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(9)
    own = bpe_fst.codec(path, P.PATTERN)
    decoder = own.decoder()
    for text in ["", "a" * 300, *("".join(rnd.choice("ab \n.,éß中\U0001f600x1") for _ in range(rnd.randrange(80))) for _ in range(500))]:
        ids = known.encode_ordinary(text)
        assert list(memoryview(own.encode(text)).cast("I")) == ids
        decoder.reset()
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
    rows = bpe_fst.round_trip(docs, path, P.PATTERN).collect()
    want = [(i, len(known.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    same([(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in rows], want)
    assert bpe_fst.round_trip(empty, path, P.PATTERN).count() == 0


def best_of(rows, k=5, every=50):
    """Brute force: (query id, rank, id, score), every row a query and a candidate of its own."""
    v = [(i, [math.floor(256 * y) for y in x]) for i, x in rows]
    want = []
    for r, (q, own) in enumerate(v):
        if q % every == 0:
            found = sorted((-min(max(sum(a * b for a, b in zip(own, x, strict=True)), -(2**63)), 2**63 - 1), c) for s, (c, x) in enumerate(v) if s != r and len(x) == len(own))[:k]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return want


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(2)
    rows = [(k, rnd.normal(0, 0.15, 16).tolist()) for k in range(300)] + [(300 + k, [0.5] * 16) for k in range(20)]
    bad = [(400, None), (450, [float("nan")] * 16), (500, [None] * 16), (None, [0.1] * 16), (550, []), (600, [float("inf")] * 16), (650, [1e308] * 16)]
    schema = "vec_id long, embedding array<double>, rid string, block string, tile int"
    df = spark.createDataFrame([(i, x, "clash", "clash", 0) for i, x in rows + bad], schema)
    for parts in ({"tile_rows": 64}, {"tile_rows": 64, "query_rows": 2, "group": 2}, {}):
        same([tuple(r) for r in topk.top_k(df, **parts).collect()], best_of(rows))
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df, k=500, tile_rows=64).where("query_id = 50").count() == 319  # all, if fewer


def test_top_k_of_repeated_ids_and_large_components(spark):
    rnd = np.random.default_rng(3)
    rows = [(50, rnd.normal(0, 0.2, 8).tolist()) for _ in range(10)] + [(k, rnd.normal(0, 0.2, 8).tolist()) for k in range(1, 10)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (200, [1.0, 2.0]), (201, [3.0, -4.0]), (7, [-1e-20] * 8)]
    of = lambda own: spark.createDataFrame(own, "vec_id long, embedding array<double>")
    same([tuple(r) for r in topk.top_k(of(rows), tile_rows=8).collect()], best_of(rows))
    large = [(50, [1e14, 3.0, -1e9]), (51, [1e14, 1.0 / 256, 2.0]), (52, [9e6, -7.5, 1e300]), (53, [3.0, 2.0, 1.0])]
    same([tuple(r) for r in topk.top_k(of(large)).collect()], best_of(large))


def test_substring_dedup(docs, texts, empty):
    seen = Counter()
    for _, t in texts:
        w = t.encode().split()
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for i, t in texts:
        w = t.encode().split()
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sum(x[2] for x in want) > 5000
    own = near_dedup.staged(docs, "test-docs")
    same([tuple(r) for r in substring_dedup.dedup(own).collect()], want)
    assert substring_dedup.clean(own).columns == docs.columns
    assert substring_dedup.dedup(near_dedup.staged(empty, "none")).count() == 0


def test_factors_copy_what_they_name(spark):
    rnd = random.Random(21)
    a, b, c, d = (prose(rnd, n) for n in (200, 90, 50, 300))
    rows = [(1, a), (1, f"{prose(rnd, 20)} {b} {prose(rnd, 9)}"), (2, f"{c} {a[40:]} {b}"), (3, f"{b} {c} {b}"), (None, c), (4, a), (5, "same " * 300), (6, None), (7, ""), (8, prose(rnd, 34))] + [(k, d) for k in (9, 10)]
    frame = near_dedup.staged(spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], SCHEMA).repartition(2), "own")
    numbered = {r["rid"]: (r["text"] or "").split() for r in substring_dedup._numbered(frame, "doc_id", "text").collect()}
    found = substring_dedup.factors(frame).collect()
    assert found
    for f in found:
        assert f["length"] >= 35 and (f["rid"], f["start"]) != (f["ref_rid"], f["ref_start"])
        assert numbered[f["rid"]][f["start"] : f["start"] + f["length"]] == numbered[f["ref_rid"]][f["ref_start"] : f["ref_start"] + f["length"]]
    whole = [(f["start"], f["length"]) for f in found if f["doc_id"] in (9, 10)]
    assert whole == [(0, 300)] * 2  # one factor goes as far as the copy does
    assert substring_dedup._cover([(f["start"], f["length"], 0, 0) for f in found if f["doc_id"] == 4], 200).all()


def test_parse_takes_the_longest_reference():
    # windows 0-13 and 14-20 can both be copied from row 9, the first also from row 3
    runs = ([0, 14, 30], [14, 7, 1], [3, 9, 5], [100, 64, 0], [9, 9, 7], [50, 64, 30])
    assert substring_dedup.parse(7, runs) == [(0, 55, 9, 50), (30, 35, 5, 0)]


def test_substring_dedup_when_partitions_change(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    passage = prose(rnd, 60)
    rows = [(k, f"{prose(rnd, 40 + 7 * k)} {passage if k % 5 == 0 else ''} {prose(rnd, 40)}") for k in range(60)]
    spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], SCHEMA).repartition(12).write.parquet(f"{tmp_path}/d")
    table, write = spark.read.parquet(f"{tmp_path}/d"), substring_dedup.staged
    plain = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(table).collect()}
    assert plain == {i: 60 if i % 5 == 0 else 0 for i, _ in rows}
    key, sizes = "spark.sql.files.maxPartitionBytes", []

    def moving(df, label):
        out = write(df, label)
        sizes.append(spark.conf.get(key))
        spark.conf.set(key, str(30_000 if len(sizes) % 2 else 1 << 27))
        return out

    monkeypatch.setattr(substring_dedup, "staged", moving)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 27))
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(table).collect()}
        spark.conf.set(key, str(1 << 27))
        sizes.clear()
        cleaned = {r["doc_id"]: len(r["text"].split()) for r in substring_dedup.clean(table).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == plain
    assert cleaned == {i: len(t.split()) - plain[i] for i, t in rows}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = labelled(random.Random(7), 300)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in rows] + [(900, rows[1][1], "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = near_dedup.staged(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = {i for i, _, q, x in rows if q and not x}
    assert len(ids & good) > 0.97 * len(good) and len(ids - good) < 5 and 900 not in ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids


def kept_by_hand(rows):
    """Rows (id, text) of which one stays for each class of near copies: that of its least id, nulls last, then the first."""
    sets, root = [near_dedup.shingles(t or "") for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    out = []
    for r in set(root):
        own = [k for k in range(len(rows)) if root[k] == r]
        out.append(min(own, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)))
    return [rows[k] for k in out]


def cleaned_by_hand(rows):
    seen = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    train = labelled(rnd, 120)
    a, b, c, passage = (prose(rnd, n) for n in (90, 80, 100, 70))
    near = c.split()
    near[50] = "other"
    rows = [(i, t) for i, t, _, _ in train] + [(1001, a), (1005, a), (1005, b), (1030, c), (1030, c), (1031, " ".join(near)), (None, prose(rnd, 60)), (None, a), (1040, None), (1041, ""), (1042, " \n "), (1043, "Ä ß " + prose(rnd, 3000))]
    rows += [(1050, f"{passage} {prose(rnd, 50)}"), (1051, f"{prose(rnd, 50)}\n{passage}"), (1052, "you idiot zorgish " + prose(rnd, 30)), (1053, "<|endoftext|> " + prose(rnd, 20))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid string, piece string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], schema).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in train], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good, toxic = quality.train(docs, labels), toxicity.train(docs, labels)
    left = [r for r, s in zip(left, good.scores([t or "" for _, t in left]), strict=True) if s >= quality.THRESHOLD]
    left = [r for r, s in zip(left, toxic.scores([t or "" for _, t in left]), strict=True) if s < toxicity.THRESHOLD]
    left = cleaned_by_hand(kept_by_hand(left))
    assert {b, c} <= {t for _, t in left} and (1001, a) in left and len([i for i, _ in left if i == 1005]) == 1
    want = Counter()
    for i, t in left:
        ids = [*by_library("byte_bpe_50k.json", t or ""), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, piece, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())) for piece, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoder_asks_in_bounded_parts():
    own, most = tokens.UnitEncoder(tokens.vocabulary("word_bpe_49k.json"), keeps_space=False), []

    class Asked:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **rest):
            most.append(sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **rest)

    texts = [f"1{k}x{k}1 word{k}" for k in range(20_000)]
    whole = [e.ids for e in own._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    own._tokenizer = Asked(own._tokenizer)
    ids, ends = own.encode_batch(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == whole
    assert max(most) <= tokens.ASK_AT_ONCE < sum(map(len, texts))
    assert tokens.parts_of([], 3) == [] and tokens.parts_of(["ab", "c", "", "defgh", "i"], 3) == [["ab", "c", ""], ["defgh"], ["i"]] and tokens.parts_of(["", "a"], 3) == [["", "a"]]
    assert own.encode_batch([])[1].tolist() == []


def test_idle_workers_forget_encoders(spark):
    import pyarrow as pa

    def held(load):
        def run(batches):
            if load:
                tokens.encoder(tokens.vocabulary("word_bpe_49k.json"), False)
            for batch in batches:
                yield pa.record_batch([pa.array([tokens.encoder.cache_info().currsize] * batch.num_rows, pa.int64())], names=["held"])

        return {r["held"] for r in spark.range(0, 4, 1, 4).mapInArrow(run, "held long").collect()}

    assert min(held(True)) > 0
    tokens.forget_everywhere(spark)
    assert held(False) == {0}


def test_units_without_a_plain_key_match(spark):
    rows = ["released under the mit", "prose\nReleased under the MIT\nmore prose", "free and unencumbered released into the public domain", "nothing of the kind here"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("unit >= 0").collect()
    sets = {n: set(licenses.bigrams_of(t)) for n, t in licenses.TEMPLATES.items()}
    want = []
    for k, text in enumerate(rows):
        for unit, part in enumerate([text, *text.split("\n")]):
            own = set(licenses.bigrams_of(part))
            less, name = min((-2.0 * len(own & s) / (len(own) + len(s)), n) for n, s in sets.items())
            if less <= -licenses.THRESHOLD:
                want.append((k, unit, name))
    assert sorted((r["doc_id"], r["unit"], r["license"]) for r in got) == want and {k for k, _, _ in want} >= {0, 1}


def test_no_match_goes_without_a_key():
    grams, _, keys, _, _ = licenses._plan(licenses.TEMPLATES, licenses.THRESHOLD)
    for name, own in grams:
        assert sum(not any(k in g for k in keys) for g in own) < licenses.needed(len(own), licenses.THRESHOLD), name


def lexicon_by_hand(sample):
    counts, rows = {0: Counter(), 1: Counter()}, Counter()
    for text, label in sample:
        words = {w.lower() for w in toxicity.re.findall(r"[^\W_]+", text)}
        rows[label] += 1
        counts[label].update(words | {w[:n] + "*" for w in words for n in range(4, min(len(w), 8) + 1)})
    out = {w: 3.0 for w in toxicity.INSULTS if not counts[0][w]}
    for feature, n in counts[1].items():
        odds = math.log((n + 0.1) / rows[1]) - math.log((counts[0][feature] + 0.1) / rows[0])
        if n >= max(4, 0.004 * rows[1]) and odds > 2.5:
            out[feature] = min(odds, 6.0)
    return out


def test_lexicon_of_texts_rich_in_words(spark):
    rnd = random.Random(5)
    rich = lambda k: " ".join(f"{rnd.getrandbits(60):x}" for _ in range(1500)) + (f" you rotten{k % 3} blockhead" if k % 2 else " a fine fool")
    sample = [(rich(k), k % 2) for k in range(120)]
    tracemalloc.start()
    got = toxicity.learn_lexicon([(t.encode(), y) for t, y in sample])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == lexicon_by_hand(sample) and {"blockhead", "rotten*", "rotten1"} <= set(got) and "fool" not in got
    assert most < 80 << 20  # counters by hash take 32 MB; every word by name took well over 100


def test_sample_reaches_the_driver_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} ä" + "x" * (2000 * (k % 7 == 0))) for k in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    fetched, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: fetched.append((self.columns, rows := collect(self))) or rows)
    got = learn.labelled_sample(docs, labels, "toxic", 20, 1000)
    assert [len([t for t, y in got if y == label]) for label in (0, 1)] == [20, 20] and max(len(t) for t, _ in got) <= 1000
    assert all(zlib.crc32(t.decode().split()[1].encode()) % 5 for t, _ in got)
    assert [len(rows) for columns, rows in fetched if "text" in columns] == [40]


def test_units_are_asked_for_words_that_no_match_lacks(spark):
    grams = {n: licenses.bigrams_of(t) for n, t in licenses.TEMPLATES.items()}
    words = set(licenses.unit_words(list(grams.values()), licenses.THRESHOLD))
    for name, own in grams.items():
        assert sum(not words & set(g.split(" ")) for g in own) < licenses.needed(len(own), licenses.THRESHOLD), name
    # prose of everyday words, and parts of words, are passed over; they used to be looked at whole
    assert not words & set("that under work other the of and is mit with another".split())
    # what no match can lack is put greedily: units of all other bigrams match nothing, with one word asked for they may
    least = {n: [g for g in own if not words & set(g.split(" "))] for n, own in grams.items()}
    assert all(2 * len(g) / (len(g) + len(grams[n])) < licenses.THRESHOLD for n, g in least.items())
    rows = [(1, "Licensed\tunder -- CC  BY 4.0"), (2, "under cc by 4 0"), (3, "\n\nunder\nthe mit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["unit"], r["license"]) for r in got if r["unit"] == 0} == {(1, 0, "CC-BY-4.0-line"), (2, 0, "CC-BY-4.0-line"), (3, 0, "MIT-line")}
    assert licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"the": "that is it"}).count() == 0
    assert [r["license"] for r in licenses.scan(spark.createDataFrame([(1, "That is it!")], "doc_id long, text string"), {"the": "that is it"}).where("unit = 0").collect()] == ["the"]


def test_index_is_sent_once_for_a_large_block_and_packed(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    vectors = np.floor(256 * rnd.uniform(-1, 1, (300, 16)))
    index = topk.Segments.of(vectors)
    parts = list(index.parts(16))
    assert len(parts) == len(topk.CHECKPOINTS) and parts[0] is next(index.parts(16))
    assert (np.abs(vectors - sum(parts)) <= topk.STEP / 2).all()  # every posting once, by its middle
    left = np.cumsum(parts, 0)
    assert np.allclose(index.left[0], np.sqrt(np.square(np.where(left[0] != 0, vectors - left[0], vectors)).sum(1)))
    for values, size in ((vectors, 2), (vectors * 256, 8), (np.array([[-(2.0**15)]]), 8), (index.places, 2)):
        raw = topk._packed(values).tobytes()
        assert len(raw) == size * values.size and (topk._unpacked(raw, values.size, values.dtype.str) == values.ravel()).all()
    # 1100 queries of 4 components were two blocks of 1024, each with its own copy of the index
    df = spark.createDataFrame([(50 * k, [float(k % 7), 1.0, 0.5, -0.25]) for k in range(1100)], "vec_id long, embedding array<double>")
    sent, search = [], topk.build_index
    monkeypatch.setattr(topk, "build_index", lambda *a: sent.append(a) or search(*a))
    found = topk.top_k(df)
    assert found.count() == 5500 and len(sent) == 1
    assert "sequence(0, 1)" not in (plan := found._jdf.queryExecution().logical().toString()) and "sequence(0, 0" in plan


def test_a_document_that_holds_its_chunks_is_summed_at_once():
    layout = token_store.Layout("", False, 1)
    ids = np.array([5, 6, 7, 8, 9], "<u2").tobytes()
    chunks = [token_store.address(ids[:4]), token_store.address(ids[4:])]
    row = {"doc_id": 1, "rid": 2, "pack": 0, "seq": 0, "n_tokens": 5, "local_start": 0, "addrs": b"".join(chunks), "lens": np.array([2, 3], "<u2").tobytes(), "held": [0, 1], "shared": [1], "data": ids, "root": token_store.merkle(chunks)}
    read = lambda **x: next(token_store._check_held(layout)(iter([token_store.pa.RecordBatch.from_pylist([row | x], token_store._types(token_store._PACKED))]))).to_pylist()[0]
    crc = lambda x: zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes())
    whole, half = read(), read(held=[1], data=ids[4:])
    assert (whole["whole"], whole["crcs"]) == (crc(ids), [token_store.UNASKED, crc(ids[4:])])
    assert (half["whole"], half["crcs"]) == (None, [None, crc(ids[4:])])
    with pytest.raises(ValueError, match="address"):
        read(data=ids[:8] + b"\0\0")
    fold = lambda x, rest: next(token_store._fold(iter([token_store.pa.RecordBatch.from_pylist([x | {"start": 0, "n_chunks": 2, "n_elsewhere": 0, "rest": rest}])]))).to_pylist()[0]["ids_crc32"]
    assert fold(whole, [{"pos": 0, "crc": 0}]) == crc(ids) == fold(half, [{"pos": 0, "crc": crc(ids[:4])}])
