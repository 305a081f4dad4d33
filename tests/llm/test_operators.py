"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows, extra columns and no rows at all;
against brute force where SQL can't say what is right."""

import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import chat, decontaminate, line_dedup, media, mixing, neardup, quality, token_files, toxicity, url_rules
from lattica.llm.shingles import Shingler

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 700}x{i}" for i in range(6000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, "THE quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (3, None, "en", None), (4, "", "de", "b"), (5, "  \n\t ", "de", "b"), (6, "one two three", None, "c"), (7, "one  two\nthree", None, "c"),
    (8, LONG, "en", "a"), (9, LONG + " tail", "en", "a"), (10, "été naïve <|endoftext|> 漢字 l1\nl2\nl3\nl4", "fr", "b"), (10, "été naïve <|endoftext|> 漢字 l1\nl2\nl3\nl4", "fr", "b"), (None, "no id", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # "row", "size", "component_id" and the like clash with columns that operators make.
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "row": F.lit("x"), "size": F.lit("y"), "component_id": F.lit("z"), "node": F.lit(1), "tie": F.lit(2)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shingles(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_shingles_match_brute_force():
    texts = [t for _, t, *_ in TEXTS]
    found = [len(np.unique(h[o : o + n])) for _, h, c in Shingler().each(texts) for o, n in zip(np.cumsum(c) - c, c, strict=True)]
    assert found == [len(_shingles(t)) for t in texts]


def test_near_duplicates_of_a_few_words_are_all_found(spark):
    # 3 of 4 shingles: pairs that agree in no band, of which there were 10 among the first 100,000 like them.
    texts = [" ".join(f"{c}{i}" for c in "abcdefgh"[:n]) for i in (17208, 29245, 32613, 45025, 49711) for n in (8, 7)]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(10)}


def test_near_duplicates(docs):
    found = {r.doc_id: r for r in neardup.near_duplicates(docs).collect() if r.doc_id is not None}
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10}
    assert {k: r.component_id for k, r in found.items()} == want
    assert all(r.n_shingles == len(_shingles(dict((i, t) for i, t, *_ in TEXTS)[k])) and r.kept == (want[k] == k) for k, r in found.items())
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "4", "5", "6", "8", "None"]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_at_the_bound_and_in_hot_groups(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(1)
    texts = []
    for k in range(60):  # variants of one text, of which some are linked through others only
        w = list(base)
        for p in rng.choice(200, rng.integers(1, 14), replace=False):
            w[p] = f"x{k}_{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(neardup, "TILE", 50)
    sets = [_shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if 100 * m >= 75 * (len(sets[i]) + len(sets[j]) - m):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert [r.component_id for r in neardup.near_duplicates(df).orderBy("doc_id").collect()] == comp


def test_token_files(docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = token_files.token_digest(docs, TOKENIZER).collect()
    assert len(got) == len(TEXTS)
    want, start = [], 0
    for i, text, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_digest(docs.limit(0), TOKENIZER).count() == 0


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    texts = ["", " ", "a ", " a", "a  b", "a   b ", "a\n b \n\nc", "x<|endoftext|> y", "\n \t a b", "it's 're  ", "é. \r\n q", "Hi, you!? ²x. 5. a.b. ’s 's."]
    assert e.by_piece
    assert e.batch(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_pieces_encode_as_whole_texts_beside_any_white_space():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    draw = np.random.default_rng(7)
    words = ["a", "Word", "the", "é", "ß", "漢字", "'s", "'re", "'", "it's", ".", ",", "!?", "5", "²", "½", "|", "###", "<|endoftext|>", "_", "-", "x1", "\u0301", "ǅ", "ʰ", "ª", "·", "×", "🙂", "\u200b", "\ufeff", "\0"]
    gaps = [" "] * 12 + ["  ", "\u00a0", "\u3000", "\t", "\n", "\r\n", "\x1c", "\x1f", "\x85", "\u2009", "\u180e", "\u2028", "\n\n", " \u00a0", "\u00a0 ", "\x0b", ""]
    texts = ["".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.integers(0, 30))) for _ in range(3000)] + [" \u00a0 \u00a0", "word \u00a0 \u00a0 word", "a\n" * 5000 + "b", " a b"]
    assert e.batch(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_documents_are_found_behind_nulls():
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out)
    for i, d in enumerate([None, None, -9, -8, -8, -1, 2]):
        writer.add(d, np.array([i], "<u4"))
    writer.finish()
    reader = token_files.TokenFileReader(io.BytesIO(out.getvalue()))
    assert [[x.tolist() for x in reader.document(d)] for d in (-9, -8, 2, 0)] == [[[2]], [[3], [4]], [[6]], []]


def test_frames_are_independent_and_checked(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 4)
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out)
    parts = [np.arange(n, dtype="<u4") for n in (3, 0, 9, 1)]
    for i, p in enumerate(parts):
        writer.add(None if i == 3 else i, p)
    writer.finish()
    raw = out.getvalue()
    reader = token_files.TokenFileReader(io.BytesIO(raw))
    assert [np.concatenate([*reader.parts(r), np.empty(0, "<u4")]).tolist() for r in range(4)] == [p.tolist() for p in parts]
    assert reader.document(2)[0].tolist() == parts[2].tolist() and reader.document(7) == []
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(p.tobytes() for p in parts)
    broken = bytearray(raw)
    broken[int(reader.packed_at[1]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFileReader(io.BytesIO(bytes(broken))).frame(1)


def test_decontamination(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, " ".join(LONG.split()[100:120])), (3, None), (4, "!!"), (5, "quick brown fox")], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_SEEDS, 7):  # one part, and several
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (12, 3, 2, True)
        assert got[2].items_sha256 == hashlib.sha256(b"1,5").hexdigest()
        assert (got[8].n_hit, got[8].contaminated, got[3].n_words, got[4].contaminated) == (20, False, 0, False)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 2
    spans = {r.doc_id: r.clean_text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert spans[1] == "the jumps over the lazy dog and runs away" and spans[6] == "one two three"
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


CLASHES = ["__nth", "__tie", "__key", "__id", "__bad", "__own_tie", "__own_nth", "__times", "nth", "key", "tie", "times", "number", "cut", "several", "node", "salt", "rows", "their_id", "bad_id", "bad_key", "band", "value", "taken"]


def test_stages_keep_clashing_columns_texts_and_nulls(spark):
    rows = [(1, LONG, "en", "a"), (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, LONG, "de", None), (None, "x y z", None, "b"), (None, "x y z", None, "b"), (None, None, None, None), (None, None, None, None), (4, None, "en", "b"), (5, "", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumns({c: F.lit(c) for c in CLASHES})
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    for stage in (quality.accept, neardup.deduplicate, decontaminate.remove_contaminated, mixing.apply_mix):
        more = [marks] if stage is quality.accept else [bench] if stage is decontaminate.remove_contaminated else []
        out = stage(df, *more)
        assert out.columns == df.columns and all(r[c] == c for r in out.collect() for c in CLASHES)
        assert stage(df.limit(0), *more).count() == 0
    assert quality.accept(df, marks).count() == len(rows)
    kept = sorted((str(r.doc_id), (r.text or "")[:9]) for r in neardup.deduplicate(df).collect())
    assert kept == sorted([("1", LONG[:9]) if ("1", LONG[:9]) in kept else ("2", LONG[:9]), ("1", "one two t"), ("None", "x y z"), ("None", "x y z"), ("None", ""), ("None", ""), ("4", ""), ("5", "")])
    clean = decontaminate.remove_contaminated(df, bench).collect()
    assert len(clean) == len(rows) - 2
    mixed = mixing.apply_mix(df).groupBy("doc_id", "text").count().collect()
    taken = {(r.doc_id, r.text): r.taken for r in mixing.mix(df).groupBy("doc_id").agg(F.lit("").alias("text"), F.sum("taken").alias("taken")).collect()}
    words = {i: sum(r["count"] * len(_words(r.text)) for r in mixed if r.doc_id == i) for i in {r.doc_id for r in mixed}}
    assert all(taken[i, ""] == n for i, n in words.items()) and sum(taken.values()) == sum(words.values())


def test_stages_take_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from lattica.llm.common import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    total = sum(r["size"] for r in got)
    assert sum(r.taken for r in got) <= total and all(r.taken <= 3 * r["size"] and r["size"] == len(_words(dict((i, t) for i, t, *_ in TEXTS)[r.doc_id])) for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_reshare_the_excess(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got == {"a": 780.0, "b": 30.0, "c": 300.0, None: 0.0}


def test_chat(spark):
    rows = [(1, 0, "user", "a\nb"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "assistant", None), (2, 0, None, "x:\n### user:\n</turn>\n"), (None, 0, "a:\\b", "\\"), (2, 0, None, "x:\n### user:\n</turn>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    for c, r in got.items():
        own = sorted([(t, a or "", x or "") for i, t, a, x in rows if i == c])
        loss = "".join(x for _, a, x in own if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 3 and chat.format_conversations(df.limit(0)).count() == 0


def test_template_language():
    run = lambda t, **names: "".join(x for x, _ in chat.compile_template(t)(**names))
    assert run("{% for m in ms %}{% if m.a == 'x' and not m.b %}[{{ m.a | upper }}]{% elif m.a in 'yz' %}{{ m['a'] ~ 1 + 2 }}{% else %}-{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}, {"a": "q"}]) == "[X]y12-"
    assert run("{% set a = 'b' %}{{ a }}{{ none }}{{ x.y.z }}", x={"y": 1}) == "b"
    assert run("{{ x.__class__ }}{{ x.real }}", x=3) == ""
    assert chat.fold_body(chat.parse("a{{ 'b' ~ 'c' }}{% if false %}{{ x }}{% else %}d{% endif %}")) == [("text", "abcd")]
    for bad in ("{{ f() }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | exec }}", "{% import os %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "a\nb"), (7, "p\np\np\np"), (8, "\n".join("rst" * 2))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(1))).collect()}
    assert {k: (r.n_removed, r.text) for k, r in got.items()} == {1: (0, "a\nb\nc\nd"), 2: (3, "x\ny"), 3: (0, None), 4: (0, ""), 5: (0, "a\nb"), 6: (2, ""), 7: (3, "p"), 8: (3, "r\ns\nt")}


def test_line_dedup_of_repeated_rows_and_no_rows(spark):
    rows = [(None, "x\ny\nz"), (None, "x\ny\nz"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, None), (3, "\n\n"), (4, "only"), (4, "one more"), (5, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "tie": F.lit(1), "drop": F.lit(1)})
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text or "") for r in line_dedup.line_dedup(df).collect())
    assert got == sorted([("None", 3, 0, "x\ny\nz"), ("None", 3, 3, ""), ("1", 3, 0, "a\nb\nc"), ("1", 3, 3, ""), ("2", 3, 3, ""), ("None", 0, 0, ""), ("3", 3, 0, "\n\n"), ("4", 1, 0, "only"), ("4", 1, 0, "one more"), ("5", 1, 0, LONG)])
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_media(docs, spark, tmp_path):
    got = media.media_features(media.store_media(docs, f"file://{tmp_path}/streams")).collect()
    assert media.media_features(media.store_media(docs.limit(0), f"file://{tmp_path}/none")).count() == 0
    assert all(r.duration_samples * 125 == r.n_frames * 3 * r.duration_hertz and list(r.frame_offsets) == sorted(r.frame_offsets) and len(r.frame_offsets) == r.n_frames for r in got)
    assert len(got) == len(TEXTS)
    for r in got:
        raw = (dict((i, t) for i, t, *_ in TEXTS)[r.doc_id] or "").encode()
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.n_frames == len(payload) // 192 and r.duration_ms == r.n_frames * 24


def test_mpeg_parser_resynchronises_and_checks():
    payload = bytes(range(192)) * 3
    stream = media.write_stream(payload, 500)
    found = media.parse(b"junk\xff\xfb" + stream[stream.index(media.HEADER) :] + b"TAG" + bytes(125))
    assert len(found["offsets"]) == 3 and found["skipped"] == 6 and "ID3v1" in found["tags"] and found["table"]["frames"] == 3
    broken = bytearray(stream)
    broken[media.parse(stream)["offsets"][1] + 8] ^= 1
    assert media.parse(bytes(broken))["crc_bad"] == 1
    assert media.parse(b"")["duration"] == 0 and media.parse(b"\xff" * 9)["offsets"] == []
    mixed = bytes((0xFF, 0xFB, 0x90, 0)) + bytes(413) + bytes((0xFF, 0xFB, 0x92, 0)) + bytes(414) + bytes((0xFF, 0xFB, 0xB0, 0)) + bytes(622)
    assert media.parse(mixed)["bitrates"] == {128: 2, 192: 1} and media.parse(mixed)["sizes"] == [417, 418, 626]


def _plain_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ b else 0)
    return crc


def _bits(raw):
    return [x >> k & 1 for x in raw for k in range(7, -1, -1)]


@pytest.mark.parametrize(
    ("header", "size", "covered"),
    [
        # Layer I, 48 kHz, 128 kbit/s: 32 allocations of 4 bits for each of two channels; mono; joint stereo from subband 8 on.
        ((0xFF, 0xFE, 0x44, 0x00), 128, lambda body: 256),
        ((0xFF, 0xFE, 0x44, 0xC0), 128, lambda body: 128),
        ((0xFF, 0xFE, 0x44, 0x50), 128, lambda body: 4 * (8 * 2 + 24)),
        # Layer II, 48 kHz, 64 kbit/s mono: 27 subbands; 44.1 kHz, 32 kbit/s mono: 8 subbands. Two more bits for each one used.
        ((0xFF, 0xFC, 0x44, 0xC0), 192, lambda body: 88 + 2 * sum(any(x) for x in _runs(body, ((4, 11), (3, 12), (2, 4))))),
        ((0xFF, 0xFC, 0x10, 0xC0), 104, lambda body: 26 + 2 * sum(any(x) for x in _runs(body, ((4, 2), (3, 6))))),
    ],
)
def test_crcs_of_layers_one_and_two(header, size, covered):
    body = bytes(np.random.default_rng(sum(header)).integers(0, 256, size - 6, np.uint8))
    n = covered(body)
    crc = _plain_crc(_bits(bytes(header[2:])) + _bits(body)[:n])
    frame = bytes(header) + crc.to_bytes(2) + body
    assert media.parse_header(frame[:4])[5] == size
    found = media.parse(frame * 2)
    assert (found["crc_good"], found["crc_bad"], len(found["offsets"])) == (2, 0, 2)
    broken = frame[:6] + bytes([frame[6] ^ 0x80]) + frame[7:]
    assert media.parse(broken * 2)["crc_bad"] == 2


def _runs(body, widths):
    bits = _bits(body)
    for w, n in widths:
        for _ in range(n):
            yield bits[:w]
            bits = bits[w:]


def test_tags_of_all_kinds():
    frames = media.write_stream(bytes(192), 3)
    audio = frames[frames.index(media.HEADER) :]
    old = b"ID3\x02\0\0" + bytes((0, 0, 0, 9)) + b"TT2" + (3).to_bytes(3) + b"abc"
    spread = b"TIT2" + (3).to_bytes(4) + b"\0\0" + b"\xff\0\x01\x02"
    third = b"ID3\x03\0\xc0" + bytes((0, 0, 0, 10 + len(spread))) + (6).to_bytes(4) + bytes(6) + spread
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    found = media.parse(old + third + audio + b"itemitem" + ape + b"TAG" + bytes(125))
    assert found["tags"]["TT2"] == b"abc" and found["tags"]["TIT2"] == b"\xff\x01\x02" and found["tags"]["APE"] == b"itemitem"
    assert "ID3v1" in found["tags"] and len(found["offsets"]) == 1 and found["skipped"] == 0 and found["crc_bad"] == 0


def test_quality_is_what_brute_force_says(spark):
    texts = ["", "plain words, and more of them.\nA line.", "JUNK!!! $$$ ### a|b|c 123", "été à la carte"]
    for t in texts:
        raw, words = t.encode(), t.encode().split()
        letters = sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in raw) + 1
        got = quality.features(t)
        assert got[0] == pytest.approx(sum(65 <= b < 91 for b in raw) / letters) and got[1] == pytest.approx(sum(48 <= b < 58 for b in raw) / (len(raw) + 1))
        assert got[3] == pytest.approx(t.count("!") / (len(raw) + 1)) and len(got) == len(quality.features(None))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r.doc_id: r.quality for r in marks.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    train = [(i, t) for i, t in rows if i in known]
    model = quality.fit(np.array([quality.features(t) for _, t in train]), np.array([known[i] for i, _ in train]))
    want = dict(zip([i for i, _ in rows], quality.score(model, np.array([quality.features(t) for _, t in rows])), strict=True))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.quality(docs, marks).collect()}
    assert got == {i: (pytest.approx(s), int(s >= 0.3), zlib.crc32(str(i).encode()) % 5 == 0) for i, s in want.items()}


def test_classifiers(docs, labels, spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for f, label, least in ((quality.quality, "quality", 0.95), (toxicity.toxicity, "toxic", 0.93)):
        r = f(real, marks).join(marks, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert r >= least
        got = f(docs, marks).collect()
        assert len(got) == len(TEXTS) and all(0 <= x.score <= 1 for x in got)
        assert f(docs.limit(0), marks).count() == 0 and f(docs, marks.limit(0)).count() == len(TEXTS)
    assert quality.accept(docs, marks).columns == docs.columns


def test_voters_that_repeat_each_other_count_once():
    draw = np.random.default_rng(2)
    toxic = draw.random(4000) < 0.2
    fires = lambda yes, no: (draw.random(4000) < np.where(toxic, yes, no)).astype(np.float32)
    a, b, c, d = (fires(0.5, 0.02) for _ in range(4))
    quiet = (a + b + c + d == 0).astype(np.float32)
    alone, parent = toxicity.label_model(np.stack([a, b, c, d, quiet], 1), 0.2, 4)
    assert ((alone > 0.5) == toxic).mean() > 0.9
    wrong = fires(0.3, 0.3)
    many = np.stack([a, b, c, d, *[wrong] * 5, quiet], 1)
    together, parent = toxicity.label_model(many, 0.2, 9)
    assert sum(4 <= p < 9 for p in parent[4:9]) == 4
    assert ((together > 0.5) == toxic).mean() > ((alone > 0.5) == toxic).mean() - 0.05


def test_voters_fire_as_brute_force_says():
    mined = [("start4", "lowe"), ("dense5/50", "lostr"), ("dense5/100", "lostr"), ("word", "zaunkönig")]
    v = toxicity.Voters(mined)
    texts = [None, "", "Loweiß und mehr", "lowe", "lostra lostri " + "und " * 60, "lostra " + "und " * 5, "Zaunkönig ZAUNKÖNIG", "you are an idiot", "GO AWAY NOW YOU LOUD PERSON OF NOTE", "der die das " * 8, LONG]
    for t in texts:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        want = {k for k in v.keys if k[0] == "word" and k[1] in words}
        want |= {k for k in v.keys if k[0] == "start4" and any(w.startswith(k[1]) and w != k[1] for w in words)}
        for k in v.keys:
            if k[0].startswith("dense"):
                n = sum(w.startswith(k[1]) and w != k[1] for w in words)
                if n > 1 and n * int(k[0].split("/")[1]) >= len(words):
                    want.add(k)
        want |= {k for k in v.keys if k[0] == "pattern" and re.search(k[1], (t or "").lower())}
        got = {v.keys[i] for i in v.fired(t)}
        assert {k for k in got if k[0] not in ("rule", "clean")} == want
        assert (("clean", "no objection") in got) == (not want)


def test_url_rules(spark, labels):
    urls = ["http://Example.com/en/x", "http://www.example.com/en/", "https://a.net/es/1", "https://a.net/en/", "nothing", None, "http://org?x=1#y", "x://com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("tokens", F.lit(0))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()}
    assert [got[i][:3] for i in range(8)] == [("example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.net", "/es/1", "net/es/"), ("a.net", "/en/", None), ("", "", None), ("", "", None), ("org", "", None), ("com", "", None)]
    assert (got[0][3], got[1][3], got[2][3], got[4][3]) == ("block", "allow", "block", "allow")
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_mined_url_rules_match_brute_force(spark):
    urls = [f"http://{'bad' if i % 3 == 0 else 'ok'}.org/{'spam' if i % 2 else 'news'}/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, int(not (i % 3 == 0 and i % 2)), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, marks, support=0.05, confidence=0.9).collect()}
    assert got == {i: "block" if i % 3 == 0 and i % 2 else "allow" for i in range(60)}


def test_mined_url_rules_see_every_token_of_long_urls(spark):
    deep = "http://a.b.c.org/one/two/three/four/five/six"
    urls = [f"{deep}/{'spam' if i % 3 == 0 else 'news'}/{i}?id=1&{'track' if i % 2 else 'page'}=2" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, int(not (i % 3 == 0 and i % 2)), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert url_rules.mine(pages, marks, 0.05, 0.9) == [(["dir:spam", "field:track"], 1.0)]


@pytest.mark.parametrize("certainty", [0.0, 0.7])
def test_mined_url_rules_are_all_minimal_ones(spark, certainty):
    draw = np.random.default_rng(5)
    parts = [sorted({f"p{k}" for k in draw.integers(0, 9, 6)}) for _ in range(80)]
    bad = [int("p1" in x and "p4" in x or draw.random() < 0.3) for x in parts]
    pages = spark.createDataFrame([(i, f"http://h.org/{'/'.join(x)}") for i, x in enumerate(parts)], "page_id long, url string")
    marks = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    baskets = [{"scheme:http", "host:h.org", "end:org", "label:h", "label:org", *(f"dir:{p}" for p in x)} for x in parts]
    want = {}
    every = sorted(set().union(*baskets))
    sure = lambda k, n: ((p := k / n) + certainty**2 / (2 * n) - certainty * (p * (1 - p) / n + certainty**2 / (4 * n * n)) ** 0.5) / (1 + certainty**2 / n) > sum(bad) / len(bad)
    for size in range(1, max(map(len, baskets)) + 1):
        for items in itertools.combinations(every, size):
            rows = [b for x, b in zip(baskets, bad, strict=True) if x.issuperset(items)]
            if sum(rows) >= 4 and sum(rows) / len(rows) >= 0.5 and sure(sum(rows), len(rows)) and not any(v >= sum(rows) / len(rows) and set(k) < set(items) for k, v in want.items()):
                want[items] = sum(rows) / len(rows)
    assert len(want) > 5 and {tuple(k): v for k, v in url_rules.mine(pages, marks, 0.05, 0.5, certainty)} == want


def test_no_rules_are_mined_where_labels_are_unrelated(spark, labels):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert url_rules.mine(pages, marks) == []
    judged = url_rules.judge(pages, marks).collect()
    assert len(judged) == pages.count() and {r.verdict for r in judged if r.rule is None} == {"allow"}


def test_rules_hold_on_pages_they_were_not_mined_from(spark):
    draw = np.random.default_rng(3)
    rows = [(i, f"http://{draw.choice(['a', 'b', 'c'])}.org/{draw.choice(['spam', 'news', 'blog'])}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([(i, int(draw.random() > (0.9 if "a.org/spam" in u else 0.1)), 0) for i, u in rows], "doc_id long, quality int, toxic int")
    r = url_rules.tried(pages, marks).first()
    assert r.n_blocked > 5 and r.n_blocked_bad / r.n_blocked > 0.7 > 2 * r.n_bad / r.n_pages


def test_url_rules_keep_repeated_rows_and_long_urls(spark, labels):
    long = "http://x.org/" + "/".join(f"part{i}" for i in range(3000)) + "?" + "&".join(f"k{i}=v" for i in range(500))
    pages = spark.createDataFrame([(1, long), (1, long), (None, "http://net/es/"), (None, None)], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = sorted(((r.page_id, r.host, r.rule, r.verdict, len(r.path)) for r in url_rules.judge(pages, labels).collect()), key=str)
    assert got == sorted([(1, "x.org", None, "allow", len(long.partition("?")[0]) - 12)] * 2 + [(None, "net", "net/es/", "block", 4), (None, "", None, "allow", 0)], key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows.append(out.count())
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert rows[0] > rows[1] > rows[2] >= rows[3] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == rows[4]
