"""Encoders, media files, pages, transcripts, fingerprints and scores: libraries, round trips, brute force, awkward rows."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readdup.llm import bpe, chat, fingerprints, html, media, quality, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BARE, SPACED = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "'s", "don't", "it's 'tis  'll''s", "\t's x", "a  b   \n c  ", " '", "we'r e", "DON'T İΣ ΟΔΟΣ", "1'2't 345 ½", "<|endoftext|>hi<|startoftext|>", "a<|endoftext|> X", "é é ​ x", "\x1c\x1da b", "aaaaaaaaaaaaa bababababa", "日本語 ﬁ", "🙂🙂x", "x" * 5000, "the of " * 3000]
ANY = st.text(st.sampled_from("ab's tlrevdmM \n\t1é́’ !.xAΣ🙂"), max_size=14)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, ids string, start int")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(BARE), tokenizers.Tokenizer.from_file(BARE)


@settings(max_examples=300, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=4))
def test_bpe_is_the_library(texts):
    own, library = test_bpe_is_the_library.both
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


test_bpe_is_the_library.both = (bpe.Codec(BARE), tokenizers.Tokenizer.from_file(BARE))


@settings(max_examples=300, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=4))
def test_encoder_is_the_library(texts):
    own, library = test_encoder_is_the_library.both
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


test_encoder_is_the_library.both = (token_files.Encoder(SPACED), tokenizers.Tokenizer.from_file(SPACED))


def test_bpe_digests_and_ids(spark, codec):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id")]
    library = codec[1]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((repr(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(docs(spark, rows), BARE).collect()]
    assert sorted(got) == sorted(want)
    ids = bpe.encode_documents(docs(spark, rows), BARE)
    assert sorted(len(r.ids) for r in ids.collect()) == sorted(w[1] for w in want)
    assert ids.limit(0).count() == 0


def test_units_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own, library = bpe.Codec(BARE), tokenizers.Tokenizer.from_file(BARE)
    for t in ("one two three four five six seven", "two eight nine ten", "one"):
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, tmp_path):
    rows = [(i * 7 % 23, t) for i, t in enumerate(ODD)] + [(None, "last"), (3, "b"), (3, "a"), (3, "a")]
    folder = f"file://{tmp_path}/tokens"
    shards = token_files.write_tokens(docs(spark, rows), folder, SPACED, 0).cache()
    got = token_files.read_tokens(shards, folder).orderBy("start").collect()
    library, at, want = tokenizers.Tokenizer.from_file(SPACED), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.write_tokens(docs(spark, rows).limit(0), f"{folder}-0", SPACED, 0).count() == 0
    (tmp_path / "tokens" / "tokens-000099.idx").write_bytes(b"something else")
    with pytest.raises(ValueError, match="no index"):
        token_files.Shard(folder, 99)


def sample_table(count, compact):
    """A movie with one track of ``count`` samples of 1 to 15 bytes, without sync table, their sizes in 4, 8 or 16 bits or in 32."""
    sizes = [1 + i % 15 for i in range(count)]
    if compact == 32:
        box = media.full(b"stsz", struct.pack(">II", 0, count), struct.pack(f">{count}I", *sizes))
    elif compact == 4:
        even = [*sizes, 0]
        box = media.full(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", count), bytes(even[i] << 4 | even[i + 1] for i in range(0, count, 2)))
    else:
        box = media.full(b"stz2", bytes([0, 0, 0, compact]), struct.pack(">I", count), struct.pack(f">{count}{'B' if compact == 8 else 'H'}", *sizes))
    payload = bytes(i % 251 for i in range(sum(sizes)))
    body = media.box(b"mdat", payload)
    table = media.box(b"stbl", media.full(b"stsc", struct.pack(">4I", 1, 1, count, 1)), box, media.full(b"stco", struct.pack(">II", 1, 8)))
    return body + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", table)))), payload, sizes


@pytest.mark.parametrize("compact", [4, 8, 16, 32])
def test_sizes_of_samples(compact):
    file, payload, sizes = sample_table(37, compact)
    (track,) = media.index(file)
    assert track.sizes.tolist() == sizes and media.read(file) == payload
    at = np.cumsum([8, *sizes])
    assert track.key_ranges() == [(int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def test_fragments():
    head = media.box(b"moov", media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, 7))), media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 10, 4, 0x10000))))

    def fragment(first, sizes):
        run = lambda place: media.full(b"trun", struct.pack(">IiI", len(sizes), place, 0), struct.pack(f">{len(sizes)}I", *sizes), flags=0x205)
        moof = lambda place: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run(place)))
        return moof(len(moof(0)) + 8) + media.box(b"mdat", bytes([first]) * sum(sizes))

    file = head + fragment(1, [3, 5]) + fragment(2, [2, 2, 2])
    (track,) = media.index(file)
    assert track.sizes.tolist() == [3, 5, 2, 2, 2] and track.keys.tolist() == [0, 2] and track.duration == 50 and track.times.tolist() == [0, 10, 20, 30, 40]
    assert media.read(file) == b"\1" * 8 + b"\2" * 6
    assert [file[a:b] for a, b in track.key_ranges()] == [b"\1\1\1", b"\2\2"]


def test_broken_media():
    whole = media.write(media.padded(b"x" * 5000))
    for cut in range(0, 2000, 7):
        with pytest.raises(ValueError):
            media.read(whole[:cut])
    with pytest.raises(ValueError, match="no track"):
        media.read(media.box(b"ftyp", b"isom"))


def test_keyframe_columns(spark):
    rows = [(1, "abc" * 9000), (2, None), (3, ""), (None, "é"), (1, "abc" * 9000)]
    got = media.media_columns(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        data = next((t or "").encode() for d, t in rows if d == r.doc_id)
        file = media.write(media.padded(data))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(media.padded(data)), len(file))
        assert r.payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest() and r.media_sha256 == hashlib.sha256(file).hexdigest()
        # every sixteenth frame is a keyframe, and stands where the payload does
        assert [file[k.start : k.end] for k in r.keyframes] == [media.padded(data)[i : i + 576] for i in range(0, len(media.padded(data)), 16 * 576)]
    assert media.media_columns(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 576 * 130])
def test_media_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = media.padded(data)
    file = media.write(payload)
    (track,) = media.index(file)
    assert media.read(file) == payload and len(payload) % 576 == 0 and payload[:n] == data
    assert (track.codec, track.handler, track.duration) == ("raw ", "soun", len(payload))
    assert all(file[a:b] == payload[576 * k : 576 * k + 576] for k, (a, b) in zip(track.keys.tolist(), track.key_ranges(), strict=True))


def test_media_tables_of_other_writers():
    sizes, runs, chunks = np.array([3, 5, 7, 2, 9]), np.array([[1, 2, 1], [2, 1, 1]]), np.array([100, 50, 300, 20])
    assert media.expand(sizes, runs, chunks).tolist() == [100, 103, 50, 300, 20]
    with pytest.raises(ValueError, match="box"):
        list(media.walk(memoryview(b"\0\0\0\xffmoov1234")))


def test_media_columns(spark):
    rows = media.media_columns(docs(spark, [*enumerate(ODD), (0, ODD[5])])).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        data = (ODD[r.doc_id] or "").encode() if r.payload_sha256 != next(x for x in rows if x.doc_id == 5).payload_sha256 else ODD[5].encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


PAGES = [
    ("<p>a<p>b<br>c", "a\n\nb\nc"),
    ("<ul><li>x<li>y<ol start=9><li>n</ol></ul>", "- x\n- y\n  9. n"),
    ("<ol type=a><li>p<li value=27>q</ol>", "a. p\naa. q"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k         value\nlong key  1"),
    ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here  z\na  b            c"),
    ("x<script>var a='</p>'</script><style>p{}</style><!-- no -->y", "xy"),
    ("<div hidden>n</div><div style='display : none'>n</div><p aria-label=none>s", "s"),
    ("<head><title>t</title></head><h1>A &amp; B</h1>  two\n words", "A & B\n\ntwo words"),
    ("<pre>  a\n   b </pre>", "  a\n   b"),
    ("<details><summary>s</summary>h</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<blockquote>q<p>r</blockquote>e", "  q\n\n  r\n\ne"),
    ("<b>a</b><i> b</i><span>c</span>", "a bc"),
    ("1 < 2 <3> </nope> &lt;ok&gt; <", "1 < 2 <3> <ok> <"),
    ("<td>loose</td><p", "loose"),
    ("", ""),
    (None, ""),
    ("<div>" * 3000 + "deep", "deep"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, p, "old") for i, (p, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table>Note<tr><td>a<td>b</table>", "Note\n\na  b"),
        ("see <table> <tr><td>a</td>stray <b>bold</b> end<td>b</tr> </table>after", "see stray bold end\n\na  b\n\nafter"),
        ("<table><tr><td>a</td></tr>rest <i>of</i><p>page</p>more &amp; more", "rest of\n\npage\n\nmore & more\n\na"),
        ("<table><caption>c</caption>x<colgroup><col>y<tbody>z<tr><td>a</table>", "xyz\n\nc\na"),
        ("<table hidden>x<tr><td>a</table><table><tr style=display:none>y<td>b</table>", "xy"),
        ("<ol><li>o<table><tr><td>a</table></ol><table><tr><table>in<tr><td>b</table></table>", "1. o\n\n   a\n\nin\n\nb"),
        ("<div>" * 198 + "<table><tr><td>deep</table>", "deep"),
    ],
)
def test_text_that_stands_in_tables(page, want):
    assert html.visible_text(page) == want


def test_no_word_of_a_table_is_lost():
    rng = random.Random(5)
    for _ in range(300):
        stray, cells, page = [], [], ["<table>"]

        def bare():
            for _ in range(rng.choice((0, 0, 1, 2))):
                stray.append(f"s{len(stray)}")
                page.append(rng.choice((" {} ", "<b> {} </b>", " {} <!-- -->", " &#115;{} ")).format(stray[-1]).replace("&#115;s", "&#115;"))  # noqa: B023

        for _ in range(rng.randint(0, 3)):
            bare()
            page.append(rng.choice(("", "<tbody>", "<thead>", "<colgroup><col>")))
            bare()
            page.append("<tr>")
            bare()
            for _ in range(rng.randint(0, 3)):
                cells.append(f"c{len(cells)}")
                page.append(f"<td>{cells[-1]}</td>")
                bare()
            page.append(rng.choice(("", "</tr>")))
        bare()
        closed = rng.random() < 0.5
        page.append("</table> s999" if closed else " s999")
        got = html.visible_text("s-1 " + "".join(page)).split()
        assert got == (["s-1", *stray, *cells, "s999"] if closed else ["s-1", *stray, "s999", *cells]), "".join(page)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div>" * 205 + "<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<table><tr><td>" + "x" * 80 + "<td>b<tr><td>y<td>c</table>", "x" * 80 + "  b\ny" + " " * 81 + "c"),
        ("<table><tr><td colspan=60>q<td>z<tr>" + "<td>cc" * 60 + "<td>e</table>", "q" + " " * 239 + "z\n" + "cc  " * 60 + "e"),
        ("<table><tr><td rowspan=3>a<td>b<tr><td>c<tr><td>d<tr><td>e<td>f</table>", "a  b\n   c\n   d\ne  f"),
        ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c", "b"),
        ("<style>.gone, #x {display:none} p.h{visibility:hidden} @media print { i {display:none} } /* b{display:none} */ u{display:none}u{display:inline}</style>"
         "<div class='a gone'>1</div><div id=x>2</div><p class=h>3<b style='visibility:visible'>4</b><p>5 <i>6</i> <u>7</u>", "4\n\n5 6 7"),
        ("a <b x='1>2'>c</b> <img alt=5\" tall> d", "a c d"),
        ("x <a href='foo", "x"),
        ("<ul><li><ol><li><blockquote>q<p>r</blockquote></ol>s<li></ul>t", "- 1.   q\n\n       r\n  s\n\nt"),
    ],
)
def test_no_limit_of_depth_width_or_span(page, want):
    assert html.visible_text(page) == want


def test_nested_blocks_against_brute_force():
    """Random trees of blocks and lists, against lines made from the inside out."""
    rng = random.Random(12)

    def tree(depth):
        return [rng.choice([rng.choice("abc") * rng.randint(1, 3), *([(rng.choice(["div", "p", "ul", "ol", "blockquote"]), tree(depth - 1))] * 2 if depth else [])]) for _ in range(rng.randint(1, 3))]

    def page(kids, tag=""):
        item = "<li>{}</li>" if tag in ("ul", "ol") else "{}"
        return "".join(item.format(k if isinstance(k, str) else f"<{k[0]}>{page(k[1], k[0])}</{k[0]}>") for k in kids)

    def lines(kids, tag=""):
        """All lines but blank ones."""
        done, now = [], ""
        for nth, k in enumerate(kids):
            if tag in ("ul", "ol"):
                mark = "- " if tag == "ul" else f"{nth + 1}. "
                done += [(" " * len(mark) if i else mark) + x for i, x in enumerate(lines([k]))]
            elif isinstance(k, str):
                now += k
            else:
                done += [now] * bool(now) + [("  " if k[0] == "blockquote" else "") + x for x in lines(k[1], k[0])]
                now = ""
        return done + [now] * bool(now)

    for _ in range(400):
        # a paragraph that opens in a paragraph ends it, so paragraphs stand alone here
        t = [("ul", tree(2)), "end"] if rng.random() < 0.5 else [("blockquote", tree(2)), ("ol", tree(1))]
        text = page(t)
        if "<p>" in text:
            continue
        got = [x for x in html.visible_text(text).split("\n") if x]
        assert got == lines(t), text


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<ul><li>a", "<table><tr><td>a", "</script ", "<a b=\"", "<table><tr><td rowspan=65534 colspan=1000>a", "</x><div>", "<td rowspan=9>", "<p><table>"])
def test_hostile_pages_take_linear_time(unit):
    def seconds(n):
        page = ("<script>" if "script" in unit else "") + unit * (n // len(unit)) + '"'
        began = time.thread_time()
        html.visible_text(page)
        return time.thread_time() - began

    seconds(10_000)
    assert seconds(400_000) < 60 * seconds(20_000) + 0.5


def test_transcripts():
    assert chat.parse(["User: hi\nhow are you?\nAssistant: fine\n\nUser: ok", "", "Q: what?\nA: that."]) == [[("user", "hi\nhow are you?"), ("assistant", "fine"), ("user", "ok")], [], [("user", "what?"), ("assistant", "that.")]]
    assert chat.render([("user", "a<|im_end|>b")]) == "<|im_start|>user\na<| im_end|>b<|im_end|>\n"


def test_blank_lines_in_a_turn_stay():
    turns = [("user", "how?"), ("assistant", "so:\n\n  one\n\n\n  two\nend"), ("user", "first\n\nsecond"), ("assistant", "ok")]
    names = {"user": "User: ", "assistant": "Assistant: "}
    assert chat.parse(["\n\n".join(names[r] + t for r, t in turns)]) == [turns]
    named = {"user": "### Human:\n\n", "assistant": "### AI:\n"}
    assert chat.parse(["\n\n\n".join(named[r] + t for r, t in turns) + "\n\n"]) == [turns]
    assert [t for p in chat.parse_parts(["User: a\n", "\n \n", "b", "Assistant: c"]) for t in p] == [("user", "a\n\n\n\n\n\n\nb"), ("assistant", "c")]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    begin, step = chat.transitions()
    scores = [rng.normal(size=(n, 6)) for n in (0, 1, 4, 2, 5)]
    for s, path in zip(scores, chat.viterbi(scores), strict=True):
        ways = {(): 0.0}
        for row in s:
            ways = {(*p, k): v + (begin[k] if not p else step[p[-1], k]) + row[k] for p, v in ways.items() for k in range(6)}
        assert tuple(path) == max(ways, key=ways.get)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi there?"), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (2, 0, None, None), (3, None, "user", ""), (None, 1, "user", "x y"), (4, 700, "user", "late one")]
    raw = chat.transcripts_of(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chat int"))
    done = {(r.conv_id, r.part): r for r in chat.format_transcripts(raw, ["conv_id", "part"]).collect()}
    assert set(done) == {(1, 0), (2, 0), (3, 0), (None, 0), (4, 1)}
    assert done[1, 0].n_turns == 2 and done[2, 0].n_turns == 0 and done[2, 0].chat == ""
    assert raw.where("conv_id = 1").first().n_turns_in == 2
    assert chat.format_transcripts(raw.limit(0), ["conv_id", "part"]).count() == 0


def whole_transcript(rows, conv):
    """A conversation's transcript, made without parts."""
    style = chat.STYLES[zlib.crc32(str(conv).encode()) % len(chat.STYLES)]
    order = sorted({(n is not None, n or 0, role, text) for c, n, role, text in rows if c == conv})
    return "\n\n".join(style[chat.ROLES.index(role)] + text for _, _, role, text in order)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_long_conversations_are_parsed_as_a_whole(spark, tmp_path, batch):
    rng = random.Random(batch)
    words = lambda n: " ".join(rng.choices("the of plan to and what is".split(), k=n))
    rows = []
    for conv in range(30):
        n = rng.choice(((1, 0), (3, 511), (1300, 0), (5, -2)))
        turns = [(k + n[1], "user" if k % 2 == 0 else "assistant", "\n".join(words(rng.randint(1, 12)) + rng.choice((".", "?")) for _ in range(rng.randint(1, 3)))) for k in range(n[0])]
        turns[0] = (turns[0][0], rng.choice(("system", "user")), turns[0][2])
        rows += [(conv, *t) for t in turns] + ([(conv, None, "system", "first")] if conv % 5 == 0 else [])
    rows += [(99, 0, "user", "a"), (99, 512, "assistant", "b"), (99, 5120, "user", "c?")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = chat.op5_chat_format(spark, str(tmp_path)).orderBy("conv_id", "part").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len({(r.conv_id, r.part) for r in got}) == len(got) and any(r.part == 2 for r in got)
    for conv in {c for c, *_ in rows}:
        (turns,) = chat.parse([whole_transcript(rows, conv)])
        mine = [r for r in got if r.conv_id == conv]
        assert "".join(r.chat for r in mine) == chat.render(turns)
        assert ",".join(r.roles for r in mine if r.roles) == ",".join(r for r, _ in turns) and sum(r.n_turns for r in mine) == len(turns)


def test_parts_of_a_transcript():
    rng = random.Random(4)
    for _ in range(300):
        lines = [rng.choice(("User: ", "Assistant: ", "A: ", "", "", "")) + rng.choice(("so it is.", "why?", "x" * 130, "")) for _ in range(rng.randint(0, 12))]
        cuts = sorted(rng.choices(range(len(lines) + 1), k=rng.randint(0, 3)))
        parts = ["\n".join(lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
        got = list(chat.parse_parts(parts))
        assert len(got) == len(parts) and [[t for p in got for t in p]] == chat.parse(["\n\n".join(parts)])


def brute_next(rows):
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {order[i]: order[(i + 1) % len(order)] for i in range(len(order))}


@pytest.mark.parametrize("ranges", [3, 1024])
def test_next_documents(spark, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", ranges)
    rows = [(i * i, f"text {i}") for i in range(40)] + [(None, "none"), (9, "text 3"), (9999, None), (-5, "")]
    got = {(r.doc_id, r.text): (r.next_id, r.next_text) for r in fingerprints.with_next(docs(spark, rows)).collect()}
    assert got == brute_next(rows)
    alone = fingerprints.with_next(docs(spark, [(1, "a b")])).collect()
    assert [(r.doc_id, r.next_id, r.next_text) for r in alone] == [(1, 1, "a b")]
    assert fingerprints.with_next(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [3, 1024])
def test_repeated_rows_have_fingerprints_of_their_own(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", ranges)
    rows = [(i, f"some text {i % 4} of words") for i in range(20)] + [(3, "some text 3 of words")] * 2 + [(3, "other"), (None, None), (None, ""), (None, "x y"), (0, "some text 0 of words"), (19, "some text 3 of words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op3_fingerprints(spark, str(tmp_path)).collect()
    own = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), ["doc_id"]).collect()}
    want = [(repr(d), len(t or ""), f"{own[i].fingerprint % (1 << 64):016x}") for i, (d, t) in enumerate(rows)]
    assert sorted((repr(r.doc_id), r.n_chars, r.fingerprint) for r in got) == sorted(want)
    hashes = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    follows = dict(zip(order, [*order[1:], order[0]], strict=True))
    edited = sorted((repr(d), hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 3] + follows[d, t or ""][1][: len(t or "") // 3]).encode()).hexdigest()) for d, t in rows)
    assert sorted((repr(r.doc_id), r.edited_sha256) for r in got) == edited
    texts = {t or "" for _, t in rows} | {(t or "")[: len(t or "") - len(t or "") // 3] + follows[d, t or ""][1][: len(t or "") // 3] for d, t in rows}
    numbered = dict(enumerate(sorted(texts)))
    of = {numbered[r.doc_id]: r.fingerprint % (1 << 64) for r in fingerprints.fingerprints(spark.createDataFrame(list(numbered.items()), "doc_id long, text string"), ["doc_id"]).collect()}
    alike = lambda a, b: 1 - (of[a] ^ of[b]).bit_count() / 64
    want = []
    for d, t in rows:
        t = t or ""
        after = follows[d, t][1]
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want.append((repr(d), f"{of[changed]:016x}", alike(t, changed), alike(t, after)))
    assert sorted((repr(r.doc_id), r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)


def test_near_fingerprints(spark, tmp_path):
    rng = random.Random(31)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(60)) for _ in range(10)]
    rows = [(i, base[i % 10] + (f" {'xyz'[i % 3]}" if i % 4 else "")) for i in range(120)] + [(140, None), (160, ""), (20, base[0]), (None, base[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.fingerprints(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), ["doc_id"]).collect()
    of = {r.doc_id: r.fingerprint % (1 << 64) if r.n_terms else None for r in found}
    want = []
    for i, (d, _) in enumerate(rows):
        if d is not None and d % 20 == 0:
            near = [of[j] for j in of if of[i] is not None and of[j] is not None and (of[i] ^ of[j]).bit_count() <= 3]
            want.append((d, max(0, len(near) - 1), max(0, len(set(near)) - 1)))
    assert sorted(map(tuple, fingerprints.near_fingerprints(spark, str(tmp_path)).collect())) == sorted(want)
    assert sum(w[2] for w in want) > 0


def test_a_search_broadcasts_no_table_that_grows(spark):
    plan = fingerprints.near_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprints(spark):
    rows = [(0, "a b c d"), (1, "A  b\tc d"), (2, ""), (3, None), (4, " "), (5, "word"), (6, "x y " * 9000)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, rows).drop("ids", "start"), ["doc_id"]).collect()}
    assert got[0].fingerprint == got[1].fingerprint != 0 and got[0].n_terms == 4
    assert [got[i].fingerprint for i in (2, 3, 4)] == [0, 0, 0] and got[2].n_terms == 0
    assert got[6].n_terms == 18000 and got[5].fingerprint != 0


def test_fingerprint_votes(spark):
    hashes = spark.sql("select xxhash64('a', 'b') x, xxhash64('b', 'longer') y, xxhash64('longer', cast(null as string)) z").first()
    weights = (2, 7, 6)
    want = 0
    for b in range(64):
        votes = sum(w if h >> b & 1 else -w for h, w in zip(hashes, weights, strict=True))
        want |= (votes > 0) << b
    got = fingerprints.fingerprints(spark.createDataFrame([(1, "a b longer")], "doc_id long, text string"), ["doc_id"]).first().fingerprint
    assert got % (1 << 64) == want


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_block_tables_find_all(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    every = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 10))) for b in base for _ in range(5)]
    signed = [x - (1 << 64) if x >> 63 else x for x in every] + [None]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = {(r.query, r.fingerprint, r.distance) for r in fingerprints.within(df, df, radius).collect()}
    want = {(a, b, ((a ^ b) % (1 << 64)).bit_count()) for a in signed[:-1] for b in signed[:-1] if ((a ^ b) % (1 << 64)).bit_count() <= radius}
    assert got == want


def test_quality(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(5, 200))).capitalize() + "." for _ in range(300)]
    bad = [" ".join(word().upper() + "!!" for _ in range(rng.randint(5, 100))) for _ in range(60)]
    rows = [(i, t, len(t), i % 2) for i, t in enumerate(good + bad)] + [(1000, None, None, 1), (1001, "", 0, 0), (None, "x", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score int")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360)] + [(3, None), (None, 1)], "doc_id long, quality int")
    machine = quality.train(df, labels)
    got = {r.doc_id: r for r in quality.score(df, machine, column="s").withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got.values())
    held = [i for i in range(360) if got[i].held]
    assert 40 < len(held) < 110 and sum((got[i].s >= 0.3) == (i < 300) for i in held) >= 0.97 * len(held)
    assert got[None].held is False
    constant = quality.train(df, labels.where("quality = 1"))
    assert len({round(r.s, 6) for r in quality.score(df, constant, column="s").collect()}) == 1
    assert quality.score(df.limit(0), machine, column="s").count() == 0


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = quality.Machine(np.zeros((1, quality.BINS - 1)), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    f, x = np.array([3, 7, 20]), np.array([0.5, -1.0, 2.0])
    want = 0.3 + (m.w[f] * x).sum() + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.raw(1, np.zeros(3, int), f, x)[0][0] == pytest.approx(want)


def test_features_of_nothing():
    of, bucket, weight, stats = quality.features(pa.array([None, "", "A b b"]), [pa.array([None, 0, 5])])
    assert set(of) == {2} and len(bucket) == 2 and stats.shape[0] == 3 and np.isfinite(stats).all() and np.isfinite(weight).all()
