import html as references
import os
import re
import time

import numpy as np
import pytest

from newsloom.llm import flac, html, urls


def test_flac_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        for data in (b"a" * n, os.urandom(n), bytes(range(256)) * (n // 256 + 1)):
            p = flac.payload(data)
            x = flac.decode_flac(flac.encode_flac(p))
            assert (np.concatenate([b[0] for b in x.blocks]) + 128).astype(np.uint8).tobytes() == p
            assert x.offsets == list(range(0, len(p), 192))


def test_flac_alike_frames_equal_one_by_one():
    data = flac.encode_flac(flac.payload(b"the sea and the land " * 300))
    info = flac.read_head(data)
    heads = flac.frame_heads(data, info)
    assert all((flac._frame(data, h) == b).all() for h, b in zip(heads, flac.decode_flac(data).blocks, strict=True))


def test_flac_writes_and_reads_linear_predictors():
    rng = np.random.default_rng(1)
    wave = (100 * np.sin(np.arange(192 * 40) / 3.7) + rng.normal(0, 2, 192 * 40)).clip(-128, 127).astype(np.int8)
    sound = (wave.astype(np.int16) + 128).astype(np.uint8).tobytes()
    for p in (sound, flac.payload(b"The sea, and the land; and a ship upon the sea? " * 200)):
        data = flac.encode_flac(p)
        x = flac.decode_flac(data)
        assert (np.concatenate([b[0] for b in x.blocks]) + 128).astype(np.uint8).tobytes() == p
        heads = flac.frame_heads(data, flac.read_head(data))
        assert all((flac._frame(data, h) == b).all() for h, b in zip(heads, x.blocks, strict=True))
        if p is sound:
            assert any(data[h.at + h.size] >> 1 >= 32 for h in heads)


@pytest.mark.parametrize("at", [0, 30, 45, 120])
def test_flac_damage_is_seen(at):
    data = bytearray(flac.encode_flac(flac.payload(b"the sea and the land " * 30)))
    data[at] ^= 4
    with pytest.raises(flac.Broken):
        flac.decode_flac(bytes(data))


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & (1 << width) - 1, f"0{width}b")

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += "0" * (u >> k) + "1"
        if k:
            self.put(u & (1 << k) - 1, k)


def stereo_stream(mid, side, weights, shift, k=3):
    """A 16-bit mid/side frame: the mid by a linear predictor with two Rice partitions, the side by an escape."""
    n = len(mid)
    w = Writer()
    order = len(weights)
    w.put(0, 1), w.put(31 + order, 6), w.put(0, 1)
    for x in mid[:order]:
        w.put(x, 16)
    w.put(7, 4), w.put(shift, 5)
    for x in weights:
        w.put(x, 8)
    w.put(0, 2), w.put(1, 4)
    for part in range(2):
        w.put(k, 4)
        for i in range(max(order, part * n // 2), (part + 1) * n // 2):
            w.rice(mid[i] - (sum(c * mid[i - 1 - j] for j, c in enumerate(weights)) >> shift), k)
    w.put(0, 1), w.put(9, 6), w.put(0, 1)
    w.put(side[0], 17)
    w.put(0, 2), w.put(0, 4), w.put(15, 4), w.put(12, 5)
    for i in range(1, n):
        w.put(side[i] - side[i - 1], 12)
    w.bits += "0" * (-len(w.bits) % 8)
    head = bytes([0xFF, 0xF8, 0x79, 0xA8, 0]) + (n - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    body = head + int(w.bits, 2).to_bytes(len(w.bits) // 8, "big")
    view = np.frombuffer(body, np.uint8)
    body += int(flac.crc16(view, np.array([0]), np.array([len(body)]))[0]).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + body


def test_flac_linear_predictor_partitions_escape_and_stereo():
    rng = np.random.default_rng(4)
    mid = [int(x) for x in np.cumsum(rng.integers(-9, 10, 64))]
    side = [int(x) for x in np.cumsum(rng.integers(-50, 51, 64))]
    x = flac.decode_flac(stereo_stream(mid, side, [60, -20, 10], 5))
    m = [a << 1 | b & 1 for a, b in zip(mid, side, strict=True)]
    assert x.blocks[0][0].tolist() == [(a + b) >> 1 for a, b in zip(m, side, strict=True)]
    assert x.blocks[0][1].tolist() == [(a - b) >> 1 for a, b in zip(m, side, strict=True)]


def test_flac_tables(odd_documents, no_documents, spark):
    rows = {r.doc_id: r for r in flac.digests(odd_documents).collect()}
    assert rows[3].n_bytes == 0 and rows[3].payload_bytes == 192
    assert rows[3].payload_sha256 == rows[4].payload_sha256
    assert flac.digests(no_documents).count() == 0
    media = spark.createDataFrame([(1, bytearray(flac.encode_flac(b"ab" * 192))), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    got = sorted((r.key, r.sample_offset, r.n_samples, r.error is None) for r in flac.pcm_blocks(media, "id", "media").collect() if r.key == 1)
    assert got == [(1, 0, 192, True), (1, 192, 192, True)]


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- x --><div class="ad">Buy now</div><header><h1>Site</h1></header><article><h1>Head &amp; line</h1><p>First  <b>part</b>.<br>Second&nbsp;one.<p>Third &lt;p&gt;.</p>
<div class="comments"><p>nice!</p></div><aside>see also</aside><form><p>mail</p></form></article><footer>&copy; x</footer></body></html>"""


def test_html_article():
    assert html.main_text(PAGE) == "Head & line\n\nFirst part. Second one.\n\nThird <p>."


def test_html_without_article():
    long = "This is the text of the page that is long enough to be decided by its words and it has many of them in it."
    page = f"<body><ul><li><a href=x>one</a><li><a href=y>two</a></ul><h2>Title</h2><p>{long}<p>Short end.<div class='sidebar'><p>{long}</div></body>"
    assert html.main_text(page) == f"Title\n\n{long}\n\nShort end."


def test_html_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (None, "u", "<p>a<p>b"), (4, "u", "<article><p>cut off"), (4, "u", "<article><p>cut off"), (5, "u", "<article>" + "<p>long text</p>" * 20_000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "1 n_chars")).collect()
    by = {r.page_id: r.text for r in got}
    assert (by[1], by[2], by[3], by[None], by[4]) == ("", "", "plain words", "a\n\nb", "cut off") and len(got) == 7
    assert by[5].count("long text") == 20_000
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PROSE = "It is a long text of the page and it has all the words that a text of this kind has in it, and more of them than the least of all."
LONG = f"{PROSE} {PROSE} {PROSE}"
NONSENSE = "zyx wvu tsr qpo nml kji hgf edc bbb aaa"
LINKS = "<ul><li><a href=a>One story of the day</a><li><a href=b>Another one of them</a><li><a href=c>Third</a></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        # names of a layout around the article lose nothing
        (f"<div class='layout with-sidebar'><article><h1>Title</h1><p>{PROSE}</article><div class=sidebar>{PROSE}</div></div>", ["Title", PROSE]),
        (f"<article class='post has-comments'><p>{PROSE}</article>", [PROSE]),
        (f"<body class='nav-open'><main class='nav-open'><p>{PROSE}</main>", [PROSE]),
        (f"<div id='ad-free-content'><article><p>{PROSE}</article></div>", [PROSE]),
        (f"<div id='ad-free-content'><p>{PROSE}</p><p>{PROSE}</p></div><p>x", [PROSE, PROSE, "x"]),
        # named parts go, inside of articles and outside
        (f"<article><p>{PROSE}<div class='ad-slot'>{PROSE}</div><div class='post-comments'><p>{LONG}</p></div><p class=newsletter>{PROSE}</article><div class=comments><p>{LONG}<p>{LONG}</div>", [PROSE]),
        (f"<header>{PROSE}</header><nav>{PROSE}</nav><article><header><h1>Title</h1></header><p>{PROSE}<aside>{PROSE}</aside><form>{PROSE}</form></article><footer>{PROSE}</footer>", ["Title", PROSE]),
        # density puts blocks of an article out: link lists with their headings, linked lines, and what stands between them
        (f"<article><h1>Title</h1><p>{PROSE}<p>Short line.<h3>Read more</h3>{LINKS}<p>{NONSENSE}<p><a href=d>Subscribe to our newsletter</a></article>", ["Title", PROSE, "Short line."]),
        (f"<article><p>{PROSE}<div><a href=d>A linked teaser that is quite long and of which all is a link to another story</a></div><p>{PROSE}<p>The end</article>", [PROSE, PROSE, "The end"]),
        # a linked title and single links within prose stay
        (f"<article><h1><a href=/>Title</a></h1><p>{PROSE} <a href=e>a link</a></article>", ["Title", f"{PROSE} a link"]),
        # an article of which nothing is decided is whole, a short one beside an advert too
        (f"<article><h1>{NONSENSE}</h1><p>xx yy</article><div class=ad>{LONG}</div>", [NONSENSE, "xx yy"]),
        ("<article></article><div class=ad>text</div>", []),
        # density takes long prose beside a small article in, and leaves a line beside a large one out
        (f"<article><p>A teaser card</article><div><h2>Title</h2><p>{LONG}<p>{LONG}</div><footer>{PROSE}</footer>", ["A teaser card", "Title", LONG, LONG]),
        (f"<p>{NONSENSE}<article><p>{LONG}</article>", [LONG]),
        # no article element: prose is in, links are out, short blocks go with their neighbours
        (f"<div>Menu {LINKS}</div><h2>Title</h2><p>{LONG}<p>Short.<p>{LONG}<div><a href=f>About us</a></div>", ["Title", LONG, "Short.", LONG]),
        ("<ul><li><a href=x>one</a></ul>", []),
        ("just text", ["just text"]),
    ],
)
def test_html_of_hand(page, want):
    assert html.main_text(page) == "\n\n".join(want)


def test_html_open_blocks_get_both_labels():
    found, _, _ = html.blocks(f"<article><p>{PROSE}<p>in<p>{PROSE}{LINKS}<p>out{LINKS}</article>")
    labels = dict(zip((b.text for b in found), html.judged(found, [False] * len(found)), strict=True))
    assert labels["in"] == html.IN and labels["out"] == html.OUT


def test_html_equals_the_articles_of_the_table(spark, sf):
    """The articles of the tables hold headings and paragraphs only."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        cut = (" ".join(references.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article))
        want = "\n\n".join(x for x in cut if x)
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id


def test_html_broken_pages_take_linear_time():
    for page in ("<a " * 1_700_000, "<head>" * 800_000, '<a "' * 600_000 + ">", "</div>" * 400_000, "<div>" * 200_000 + "</section>" * 200_000, "x &amp " * 600_000):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 20
    assert html.main_text("a < b &lt; c") == references.unescape("a < b &lt; c")


def test_automaton_equals_patterns():
    globs = ["*.com/en/**", "**/ads/**", "a?c", "*spam*.**", "**", "x*y*z", "*" * 3 + "q", "longer-than-sixty-four-bytes-" * 4 + "*"]
    texts = ["", ".com/en/x", ".a.com/en/", "a/b.com/en/", "/ads/", "x/ads/y", "abc", "a/c", ".my-spam.org", "xyz", "xaybz", "xa/ybz", "longer-than-sixty-four-bytes-" * 4 + "tail", "zzzq"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hit = urls.Automaton(globs).matches(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))

    def pattern(g):
        return re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {4: "(?:.|\n)*", 2: "[^/]*"}[len(m[0])] if "*" in m[0] else "[^/]", re.escape(g.replace("***", "**")))

    for j, g in enumerate(globs):
        assert hit[:, j].tolist() == [bool(re.fullmatch(pattern(g), t)) for t in texts], g


def test_url_rules(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/7a?x#y"), (2, "http://example.com/en/8"), (3, "https://example.net/de/81"), (4, "https://example.net/de/91"), (5, None), (6, "nothing"), (7, "http://x.org"), (8, "http://com/en/"), (9, "http://xcom/en/"), (10, "http://cheap-pills.example.com/fr/"), (None, "http://a.org/es/q")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 rule", "2 host")).collect()}
    assert got[1] == ("www.example.com", "/en/7a", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("x.org", "", None, "allow")
    assert got[8][2:] == ("com/en/", "block") and got[9][2:] == (None, "allow") and got[10][2:] == (None, "block") and got[None][2:] == ("org/es/", "block")
