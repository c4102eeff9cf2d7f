"""Pages, pieces, audio, and the pipeline."""

import functools
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkfold.llm import html_wrapper as hw
from sparkfold.llm import mpeg_audio as mp
from sparkfold.llm import prefix_viterbi as pv

# --- pages


def test_extraction():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><div class="site-header"><a href=/>Home</a></div><nav>menu</nav><div id=content><h1>T &amp; x</h1>'
        "<p>Hello <b>wor</b>ld<br>next&nbsp;line<p>two <!-- no --> &lt;b&gt; 3 < 4<div class='ad-box'>buy</div><table><tr><td>a<td>b</table><div id='comments'><p>first!</p></div></div>"
        "<form><input>go</form><aside>x</aside><script>if(a<b){'</p>'}</script><span hidden>no</span><footer>f</footer>"
    )
    assert hw.extract(hw.parse(page), None) == "T & x Hello world next line two <b> 3 < 4 a b"
    assert hw.extract(hw.parse("<div class=header>x</div><figure><figcaption>c</figcaption></figure><div class=entry-header>t</div>"), None) == "c t"
    assert hw.extract(hw.parse("<body><p>out</p><article><header><h1>H</h1>by me</header><p>in"), None) == "H in"
    for x, want in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a <b", "a"), ("<div>" * 5000 + "deep", "deep"), ("<p>" * 3000 + "x", "x"), ('<a href="x>y</a> z', "y z")):
        assert hw.extract(hw.parse(x), None) == want


def page(i, extra="", items=3):
    lis = "".join(f"<li><a href=/{j}>link {j}</a></li>" for j in range(items))
    return f"<body><div><ul>{lis}</ul></div><div class=x>Same notice everywhere</div>{extra}<div class=y><h1>Title {i}</h1>" + "".join(f"<p>Body {i} {j}</p>" for j in range(1 + i % 3)) + "</div>"


def test_wrappers_find_groups_options_and_constants(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", page(i, "<section>maybe</section>" if i % 5 == 0 else "", 2 + i % 4)) for i in range(60)]
    rows += [(100, None, None), (101, "http://h0.org/z", ""), (102, "nonsense", "<p>lone"), (1, "http://h1.org/1", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).repartition(5)
    got = sorted((tuple(r) for r in hw.extract_pages(df).collect()), key=str)
    assert len(got) == len(rows)
    for i, url, text, n in got:
        assert n == len(text)
        if i < 60:
            want = [f"Title {i}"] + [f"Body {i} {j}" for j in range(1 + i % 3)]
            assert text == " ".join((["maybe"] if i % 5 == 0 else []) + want), text
    assert {t for i, _, t, _ in got if i >= 100} == {"", "lone"}
    w = None
    for i in range(10):
        w = hw.combine(w, hw.skeleton(hw.parse(page(i, "<section>m</section>" if i else ""))))
    flat = hw.judge(w).dump().__repr__()
    (body,) = w.kids
    ul = body.kids[0].kids[0]
    assert ul.kids[0].many and ul.flag and [k.opt for k in body.kids] == [False, False, True, False]
    assert hw.Node.load(eval(flat)).dump() == w.dump()
    assert hw.extract_pages(df.limit(0)).collect() == []


def test_hosts_beyond_the_bound_are_counted_exactly(spark):
    """Templates of their own in every sixth page fill the wrapper; what is left out is decided by counts."""

    names = [a + b for a in "ghijkmqrstuvwxyz" for b in "ghijkmqrstuvwxyz" * 2][:500]

    def many(i):
        t = i % 6
        lis = "".join(f"<li><a href=/{j}>link {j}</a></li>" for j in range(3))
        own = "".join(f"<div class=k{'abcdef'[t]}{x}{'pq'[y % 2]}>w {i} {y}</div>" for y, x in enumerate(names))
        return f"<body><div class=t{'abcdef'[t]}>{own}<ul>{lis}</ul><div class=x>Body {i}</div></div><div class=zz>Same notice everywhere</div></body>"

    df = spark.createDataFrame([(i, f"http://h.org/{i}", many(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    assert hw.wrappers(df.withColumn("host", F.lit("h"))).first().full
    for r in hw.extract_pages(df).collect():
        assert r.text == " ".join(f"w {r.page_id} {y}" for y in range(500)) + f" Body {r.page_id}"


def test_embedded_elements_end_where_they_end():
    for x, want in (
        ('<article><p>a <svg width="1"/> b<p>c</article>', "a b c"),
        ("<article><p>a<video src=x/>b<p>c</article>", "ab c"),
        ("<article><audio src=x><p>a<p>b</article><div>out</div><audio>no</audio>", "a b"),
        ("<p>a <svg><g><svg><text>no</text></svg><text>no</text></g></svg> b", "a b"),
        ("<p>a <object><object><p>no</object><p>no</p></object> b<object><p>c", "a b c"),
        ("<ul><li>a<template><li>no</li></template> b<li>c</ul>", "a b c"),
        ("<p>a<svg><title/><style/><path/></svg>b<select><option>no<option>no</select>c", "abc"),
        ("<div>" * 400 + "a<svg><g>no<path></svg>b" + "</div>" * 400 + "c", "ab c"),
        ("<p>a<canvas>" * 3000 + "b", " ".join(["a"] * 3000 + ["b"])),
        ("<p>a<script>no<svg></script>b<textarea><p>no</textarea>c", "abc"),
    ):
        assert hw.extract(hw.parse(x), None) == want, x[:80]


def test_wrappers_decide_inside_articles():
    def marked(i):
        own = "<ul><li><a href=/>own source</a></li></ul>" if i == 7 else ""
        return f"<body><article><div class=k>Read our terms first</div><h1>Title {i}</h1><p>Body {i}</p>{own}<div class=z><ul><li><a href=/>More of this</a></li></ul></div></article></body>"

    w = None
    for i in range(20):
        w = hw.combine(w, hw.skeleton(hw.parse(marked(i))))
    hw.judge(w)
    for i in range(20):
        assert hw.extract(hw.parse(marked(i)), w) == f"Title {i} Body {i}" + (" own source" if i == 7 else "")


def test_names_are_weak_evidence():
    for x, want in (
        ('<div class="content has-sidebar"><h1>T</h1><p>Body text</div>', "T Body text"),
        ('<article class="no-sidebar"><p>Body</article>', "Body"),
        ('<body><div class="post related-2"><p>Body of some length</div><div class="related"><p>Other</div>', "Body of some length"),
        ('<body><div id="search-engine-article"><p>Body of some length</div><div class=ad>Buy</div>', "Body of some length"),
        ('<body><div class="page sidebar"><article><p>Body</article></div><div class="sidebar">A very long text beside the article, longer than it</div>', "Body"),
        ('<article class="post comments-open"><p>Body</p><div class="comments"><p>A much longer comment than the body</div></article>', "Body"),
        ("<body><p>Body</p><div class=comments><p>A much longer comment than the body is</div>", "Body"),
        ("<body><p>Body of some length</p><div class=widget>x</div>", "Body of some length"),
    ):
        assert hw.extract(hw.parse(x), None) == want, x


def test_deep_elements_keep_order_and_what_their_parents_say():
    deep = "<div>" * 300
    for x, want in (
        (deep + "a<div>b</div>c<div class=ad>no<p>no</div>d", "a b c d"),
        (deep + "<nav><div>no<div>no</div>no</div></nav>e", "e"),
        (deep + "<article><div>in<div>in2</div></div></article><p>out", "in in2"),
        (deep + "<ul><li>1<li>2</ul>" + "</div>" * 300 + "z", "1 2 z"),
    ):
        assert hw.extract(hw.parse(x), None) == want, x[1500:]
    assert hw.extract(hw.parse("<div>" * 50_000 + "</b></span>" * 50_000 + "</section>" * 50_000 + "x"), None) == "x"


def test_alignment_is_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))

        @functools.cache
        def longest(i, j, a=tuple(a), b=tuple(b)):
            if i == len(a) or j == len(b):
                return 0
            return max(longest(i + 1, j), longest(i, j + 1), 1 + longest(i + 1, j + 1) if a[i] == b[j] else 0)

        got = hw._common(a, b)
        assert len(got) == longest(0, 0) and all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:], strict=False))
    assert len(hw._common(list(range(3000)), [0, *range(5, 3000)])) == 2996


def test_unmarked_pages_under_partitionings(spark):
    """Without article or main the wrapper decides: notices on 19 of 20 pages go, whatever the partitioning."""

    def unmarked(i):
        notice = "Same notice everywhere" if i % 20 else f"Another one {i}"
        return f"<body><div class=a><ul><li><a href=/>one</a><li><a href=/>two</a></ul></div><div class=b>{notice}</div><div class=c><h2>Title {i}</h2><p>Body {i}</p></div><div class=d>All rights {'' if i % 2 else ''}kept</div></body>"

    df = spark.createDataFrame([(i, "http://u.org/x", unmarked(i)) for i in range(100)], "page_id long, url string, html string")
    df = df.withColumns({"wrapper": F.lit(1), "full": F.lit(2), "text": F.lit("t")})
    results = [sorted((r.page_id, r.text) for r in hw.extract_pages(df.repartition(n)).collect()) for n in (1, 3, 70)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 100
    assert [t for i, t in results[0] if i % 20] == [f"Title {i} Body {i}" for i in range(100) if i % 20]


def test_large_wrappers_travel_with_their_pages(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 3}.org/", page(i)) for i in range(60)], "page_id long, url string, html string")
    sent = sorted(map(tuple, hw.extract_pages(df).collect()))
    monkeypatch.setattr(hw, "SENT_BYTES", 0)
    assert sorted(map(tuple, hw.extract_pages(df).collect())) == sent


def test_repeated_groups_fold():
    root = hw.skeleton(hw.parse("<dl>" + "<dt>a</dt><dd>b</dd>" * 5 + "</dl>"))
    (dl,) = root.kids
    assert [k.key for k in dl.kids] == ["()"] and [k.key for k in dl.kids[0].kids] == ["dt.#", "dd.#"]


def test_pages_of_the_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in hw.op4_html_wrapper(spark, sf).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", a))).split())


# --- pieces

TOY = [("<unk>", 0.0, 2), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -9.0, 1), ("a", -8.0, 1), ("b", -8.0, 1), ("ab", -5.0, 1), ("▁a", -4.0, 1), ("ba", -6.0, 1), ("aba", -7.0, 1), ("▁▁", -1e9, 1)]


def test_viterbi_is_the_best_segmentation():
    p = pv.Pieces(pv.Model(TOY, False))
    scores = {t.replace("▁", " "): s for t, s, k in TOY if k == 1}

    @functools.cache
    def best(w):
        if not w:
            return 0.0
        options = [scores[w[:j]] + best(w[j:]) for j in range(1, len(w) + 1) if w[:j] in scores]
        return max(options + ([p.unknown + best(w[1:])] if w[0] not in scores else []))

    rnd = random.Random(2)
    words = sorted({" " + "".join(rnd.choice("abz") for _ in range(rnd.randrange(9))) for _ in range(300)})
    for w, got in zip(words, p.encode_sorted(words), strict=True):
        ids = np.frombuffer(got, np.int32)
        assert abs(sum(TOY[i][1] if i > 256 else p.unknown for i in ids) - best(w)) < 1e-6
        assert b"".join(p.text[i] for i in ids).decode() == w


def test_viterbi_of_a_merging_model_is_what_its_merges_make():
    """Also where pieces tie, where a piece is reached by no merge, and where characters have no piece."""
    toy = [*TOY, ("bab", -3.0, 1), ("▁▁▁", -1e9, 1), ("bb", -5.0, 1), ("abba", -5.0, 1), ("c", -2.0, 1), ("caca", -1.0, 1)]
    p = pv.Pieces(pv.Model(toy, True))
    rnd = random.Random(4)
    words = sorted({" " * rnd.randrange(6) + "".join(rnd.choice("aabbcz") for _ in range(rnd.randrange(12))) for _ in range(2000)} - {""})
    for w, got in zip(words, p.encode_sorted(words), strict=True):
        want = [x if x in p.score else f"<{x}>" for x in p.merged(w)]
        ids = np.frombuffer(got, np.int32)
        assert [p.plain[i] or f"<{chr(i - 1)}>" for i in ids] == want, w


@pytest.mark.skipif(not os.path.exists(pv.MODEL), reason="no tokenizer files")
def test_pieces_are_the_models_own(spark, sf):
    """Texts without runs of blanks, which the model's encoder folds, get its pieces."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pv.MODEL)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null and not text rlike '^ | $|  '")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: list(r.ids) for r in pv.encode(docs).collect()}
    assert len(got) > 100 and all(got[i] == own.encode(t) for i, t in texts.items())


def test_a_missing_model_fails_at_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(FileNotFoundError):
        pv.encode(df, str(tmp_path / "none.model"))


@pytest.mark.skipif(not os.path.exists(pv.MODEL), reason="no tokenizer files")
def test_round_trip(spark):
    texts = ["a ▁ b", "  two  spaces \n\n x", "日本語 é 🙂", "", None, " ", "\n", "\r\n\tx\x00", "x" * 30_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("x"))
    enc = pv.encode(df)
    assert {r.doc_id: r.text for r in pv.decode(enc).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.exact and r.n_pieces == len(r.ids) for r in enc.collect())
    assert pv.encode(df.limit(0)).collect() == []


# --- audio


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1417, 1418, 100_000])
def test_audio_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = mp.pack(data)
    s = mp.parse(media)
    assert mp.payload(media, s) == data and s.skipped == 0 and s.crc_bad == 0
    assert s.vbr == "Xing" and s.vbr_frames == len(s.offsets) and s.samples == 1152 * len(s.offsets) and s.rate == 32000


def test_audio_resynchronises_and_verifies():
    media = mp.pack(bytes(range(256)) * 20)
    at = mp.parse(media).offsets[1]
    hurt = bytearray(media)
    hurt[at + 8] ^= 1
    assert mp.parse(bytes(hurt)).crc_bad == 1
    junk = mp.parse(media[:at] + b"\xff\xfb junk \xff" + media[at:] + b"TAG" + bytes(125))
    assert junk.skipped == 9 and len(junk.offsets) == len(mp.parse(media).offsets)
    assert mp.parse(b"").samples == 0 and mp.parse(b"\xff" * 100).offsets == [] and mp.parse(media[: at + 50]).skipped > 0


def test_audio_payload_that_looks_like_a_tag():
    n = 100_000
    for at in range(n - 400, n - 2):
        data = bytes(at) + b"TAG" + bytes(n - at - 3)
        media = mp.pack(data)
        s = mp.parse(media)
        assert mp.payload(media, s) == data and s.skipped == 0 and s.vbr_frames == len(s.offsets)
    with pytest.raises(ValueError):
        mp.payload(media[:-10], mp.parse(media[:-10]))


def test_audio_headers():
    h = mp.header(0xFFFB9064)
    assert (h.layer, h.kbits, h.rate, h.length, h.samples, h.protected) == (3, 128, 44100, 417, 1152, False)
    h = mp.header(0xFFF38064)
    assert (h.layer, h.version, h.kbits, h.rate, h.samples) == (3, 2, 64, 22050, 576)
    assert mp.header(0xFFFF1000) is not None and mp.header(0xFFFF1000).layer == 1
    assert mp.header(0) is None and mp.header(0xFFFBF064) is None


def slow_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ b else 0)
    return crc


def layer_two(rnd, kbits, rate_at, mode, ext, version=3):
    """A protected Layer II frame with random allocations, its checksum from the standard's text, bit by bit."""
    word = 0x7FF << 21 | version << 19 | 2 << 17 | mp.KBITS[version == 3, 2].index(kbits) << 12 | rate_at << 10 | mode << 6 | ext << 4
    h = mp.header(word)
    channels = 1 if mode == 3 else 2
    each = kbits // channels
    if version != 3:
        widths = [4] * 4 + [3] * 7 + [2] * 19
    elif each <= 48:
        widths = [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    else:
        widths = [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each <= 80 else 7)
    bits, selections = [], 0
    for sb, width in enumerate(widths):
        joint = mode == 1 and sb >= 4 * (ext + 1)
        for _ in range(1 if joint else channels):
            x = rnd.choice((0, rnd.randrange(1 << width)))
            bits += [x >> i & 1 for i in range(width - 1, -1, -1)]
            selections += 2 * (x != 0) * (2 if joint else 1)
    bits += [rnd.randrange(2) for _ in range(selections)]
    crc = slow_crc([word >> i & 1 for i in range(15, -1, -1)] + bits)
    bits += [rnd.randrange(2) for _ in range(-len(bits) % 8)]
    body = bytes(sum(b << 7 - i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
    frame = word.to_bytes(4, "big") + crc.to_bytes(2, "big") + body
    return frame + bytes(h.length - len(frame))


def test_audio_checksums_of_layer_two():
    rnd = random.Random(3)
    kinds = [(32, 0, 3, 0, 3), (48, 2, 3, 0, 3), (64, 1, 3, 0, 3), (192, 0, 0, 0, 3), (192, 0, 1, 1, 3), (384, 2, 1, 3, 3), (96, 2, 2, 0, 3), (64, 0, 1, 2, 2), (80, 1, 3, 0, 2)]
    for kind in kinds:
        frames = [layer_two(rnd, *kind) for _ in range(4)]
        got = mp.parse(b"".join(frames))
        assert (got.layer, len(got.offsets), got.crc_checked, got.crc_bad) == (2, 4, 4, 0), kind
        broken = bytearray(frames[1])
        broken[7] ^= 16
        assert mp.parse(frames[0] + bytes(broken) + frames[2]).crc_bad == 1


def test_audio_free_format():
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 3 << 6
    frames = [(word | pad << 9).to_bytes(4, "big") + bytes([i]) * (500 + pad) for i, pad in enumerate((0, 1, 0, 0, 1))]
    got = mp.parse(b"junk" + b"".join(frames))
    assert got.skipped == 4 and len(got.offsets) == 5 and [b - a for a, b in zip(got.offsets, got.offsets[1:], strict=False)] == [504, 505, 504, 504]
    assert got.samples == 5 * 1152 and got.bitrates == {0}
    assert mp.parse(frames[0]).offsets == []


def test_audio_tags_and_tables():
    frame = mp._FRAMES[3][1] + bytes(mp._FRAMES[3][2] - len(mp._FRAMES[3][1]))
    field = lambda body: b"TT2" + len(body).to_bytes(3, "big") + body
    two = field(b"\0Old title") + b"TXX" + (8).to_bytes(3, "big") + b"\0key\0val"
    sync = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    old = mp.parse(b"ID3\x02\0\0" + sync(len(two)) + two + frame * 2)
    assert old.tags == {"TT2": "Old title", "key": "val"} and len(old.offsets) == 2
    body = b"\x01\xff\xfeh\0i\0"
    three = (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + len(body).to_bytes(4, "big") + b"\0\0" + body
    three = three.replace(b"\xff", b"\xff\x00")
    assert mp.parse(b"ID3\x03\0\xc0" + sync(len(three)) + three + frame * 2).tags == {"TIT2": "hi"}
    last = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\x11"
    got = mp.parse(frame * 2 + last)
    assert got.tags == {"title": "Title", "artist": "Artist", "year": "1999", "comment": "note", "track": "7"} and got.skipped == 0
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 5000, 9, 3, 2, 2, 3) + struct.pack(">HHH", 10, 20, 30)
    plain = (0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 9 << 12 | 3 << 6).to_bytes(4, "big")
    size = mp.header(int.from_bytes(plain, "big")).length
    got = mp.parse(plain + bytes(32) + table + bytes(size - 36 - len(table)) + (plain + bytes(size - 4)) * 2)
    assert (got.vbr, got.vbr_bytes, got.vbr_frames, got.points, len(got.offsets)) == ("VBRI", 5000, 9, [20, 60, 120], 2)


def test_audio_table(spark):
    df = spark.createDataFrame([(1, "text"), (2, "text"), (3, None), (None, "x" * 64)], "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in mp.inspect(mp.store(df)).collect()}
    padded = b"text" + bytes(60)
    assert got[1].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[1].tail_crc32 == zlib.crc32(padded)
    assert (got[1].n_bytes, got[1].payload_bytes, got[3].n_bytes, got[3].payload_bytes, got[None].payload_bytes) == (4, 64, 0, 64, 64)
    assert [getattr(got[1], c) == getattr(got[2], c) for c in ("media_sha256", "feature", "media_bytes")] == [True] * 3
    assert mp.inspect(mp.store(df.limit(0))).collect() == []


# --- pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        assert docs.where("n_chars <> char_length(text)").count() == 0 or name == "quality rules"
        ids = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("not exact").count() == 0


def test_pipeline_drops_near_copies_from_080(spark):
    words = [f"w{i}" for i in range(104)]
    near = [*words[:50], "other", *words[51:]]  # 95 shingles of 105 shared: 0.905
    mid = [*words[:30], "x", *words[31:70], "y", *words[71:]]  # 90 of 110 shared: 0.818
    far = [*words[:20], "p", *words[21:50], "q", *words[51:80], "r", *words[81:]]  # 85 of 115: 0.739
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in ((1, words), (2, mid))]
    rows += [(i, " ".join(f"{tag}{w}" for w in t), "en", "s", 1) for tag, group in (("a", ((3, words), (4, far))), ("b", ((5, words), (6, near)))) for i, t in group]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4, 5]


def test_pipeline_drops_documents_that_line_dedup_empties(spark):
    rows = [(1, "a line of many words\nb", "en", "s", 1), (2, "A line of many words", "en", "s", 1), (3, " a line of many words\n\nshort", "en", "s", 1), (4, None, "en", "s", 1), (None, "one more line here", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: ("a line of many words\nb", 22), 3: ("\nshort", 6), None: ("one more line here", 18)}
    assert corpus_pipeline.drop_repeated_lines(spark, docs.limit(0), "").collect() == []


@pytest.mark.skipif(not os.path.exists(pv.MODEL), reason="no tokenizer files")
def test_pipeline_against_plain_python(spark, tmp_path):
    """run() against the stages in plain Python; mixing by its SQL; without labels only the base rule rejects."""
    import duckdb

    from sparkfold.llm.mixing import OP1_SQL

    rnd = random.Random(5)
    rows = []
    for i in range(14):
        words = [f"d{i}w{j}" for j in range(104)]
        lines = ["Shared line of many documents"] * (i % 3 == 0) + [" ".join(words[:52]), " ".join(words[52:])]
        rows.append((3 * i + 1, "\n".join(lines), "en", "abc"[i % 3], 1))
        if i % 4 == 1:  # near copies; two or three words apart: 0.81 or 0.73 alike
            other = list(words)
            for j in (20, 75) if i < 9 else (20, 50, 80):
                other[j] = f"x{rnd.randrange(999)}"
            rows.append((3 * i + 2, " ".join(other), "en", "abc"[i % 3], 1))
    rows += [(90, "too short", "en", "a", 1), (91, "same three words " * 30, "en", "b", 1), (92, None, "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def base_rule(text):
        w = (text or "").split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        return len(w) >= 50 and 2 * len(covered) <= len(w)

    docs = [(i, t, s) for i, t, _, s, _ in rows if base_rule(t)]
    assert len(docs) == len(rows) - 3
    first: dict[str, int] = {}
    for i, t, _ in sorted(docs):
        for x in t.split("\n"):
            first.setdefault(x.strip().lower(), i)
    docs = [(i, "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == i), s) for i, t, s in docs]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    near = {i for i, t, _ in docs for j, u, _ in docs if j < i and 5 * len(shingles(t) & shingles(u)) >= 4 * len(shingles(t) | shingles(u))}
    docs = [d for d in docs if d[0] not in near]
    assert near
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    copies = {i: taken // size for i, size, taken in c.execute(f"SELECT doc_id, size, taken FROM ({OP1_SQL})").fetchall()}
    want = sorted((i, t) for i, t, _ in docs for _ in range(copies[i]))
    pieces = pv.Pieces(pv.Pieces.load(pv.MODEL))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, pieces.decode(r.ids)) for r in got) == want and all(r.exact for r in got)


def test_texts_are_cut_once_and_borders_stop_merges(monkeypatch):
    p = pv.Pieces(pv.Model([*TOY, ("bab", -3.0, 1), ("bb", -5.0, 1), ("abba", -5.0, 1)], True))
    cut, real = [], p.words
    monkeypatch.setattr(p, "words", lambda t: cut.append(t) or real(t))
    texts = ["ab abba\nb", None, "", "zab  bab ab"]
    ids, words = pv.Encoder(p)(texts)
    assert cut == texts and words == [len(real(t)) for t in texts]
    assert [p.decode(x.tolist()) for x in ids] == [t or "" for t in texts]
    rnd = random.Random(6)
    for _ in range(2000):
        x, y = ("".join(rnd.choice("abz") for _ in range(rnd.randrange(1, 6))) for _ in range(2))
        assert (p.merged(x + y, len(x)) == [x, y]) == (p.merged(x + y) == [x, y])
