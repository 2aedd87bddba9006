"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import html.parser
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tideline.llm import common as C
from tideline.llm import hashing as H
from tideline.llm import op1_suffix as op1
from tideline.llm import op2_minhash as op2
from tideline.llm import op3_sentencepiece as op3
from tideline.llm import op4_ogg as op4
from tideline.llm import op5_html as op5
from tideline.llm import op6_pii as op6
from tideline.llm import op7_lm as op7
from tideline.llm import op8_quality as op8
from tideline.llm import op9_packing as op9
from tideline.llm import op10_language as op10
from tideline.llm.registry import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SP = P.path("piece_bpe_32k.model")
BPE = P.path("byte_bpe_50k.json")


def docs_of(spark, texts, ids=None, **more):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", "src0", 0, "x", "y") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, n string")


EDGE = [None, "", " ", "\n\t", "a", "A b", "é😀 x", "word " * 3000, "same text here", "same text here", "\x00 \x1c x"]


def find(par, x):
    while par[x] != x:
        par[x] = par[par[x]]
        x = par[x]
    return x


# ---- 1: exact substrings ------------------------------------------------------------------


def brute_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        spans = int((hit[1:] & ~hit[:-1]).sum() + hit[0])
        out.append((len(b), int(hit.sum()), spans, bytes(x for x, c in zip(b, hit) if not c)))
    return out


@pytest.mark.parametrize("seed,hot", [(0, 20_000), (1, 20_000), (2, 2), (3, 2), (4, 10), (5, 0)])
def test_suffix_dedup(spark, seed, hot):
    r = random.Random(seed)
    src = ["".join(r.choice("ab" if seed % 2 else "abcdé \n\x00") for _ in range(300)) for _ in range(4)]
    texts = [None, "", "x" * 200, "y" * 39, "z" * 41]
    for _ in range(30):
        t = ""
        for _ in range(r.randint(0, 5)):
            p, i = r.choice(src), r.randint(0, 200)
            t += p[i : r.randint(i, 300)] + r.choice(["", "q", "é"])
        texts.append(t)
    texts += texts[5:8]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in op1.dedup(docs_of(spark, texts), 40, 12, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts, 40)


@pytest.mark.parametrize("words", [False, True])
def test_suffix_anchors(words):
    """Every window has one owner, equal windows have theirs at the same offset; of words only whole ones are looked at."""
    r = random.Random(6)
    src = [r.choice(["ab", "cde", "é", "x"]) for _ in range(300)]
    texts = [None, "", " \n", "one", *[" ".join(src[i : i + r.randint(1, 200)]) for i in (r.randrange(250) for _ in range(12))], ""]
    unit = op1.WORD_BYTES if words else 1
    kind = op1.Kind(20 * unit, 5 * unit, words)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    symbols = [(t or "").split() if words else list((t or "").encode()) for t in texts]
    owner = {}
    for h, text, at, lo, hi in zip(*(x.tolist() for x in op1.anchors_of(batch, [kind])[0])):
        assert at % unit == lo % unit == hi % unit == 0 and lo <= at <= lo + kind.length - kind.k and hi <= at
        for start in range(lo, hi + 1, unit):
            assert (text, start // unit) not in owner
            owner[text, start // unit] = (h, at - start)
    assert set(owner) == {(i, j) for i, s in enumerate(symbols) for j in range(len(s) - 19)} and len(owner) > 300
    by_window = {}
    for (i, j), got in owner.items():
        assert by_window.setdefault(tuple(symbols[i][j : j + 20]), got) == got


def test_suffix_anchor_cost():
    """Looking for repeats of words costs a k-gram a word, not one for each byte that stands for it."""
    seen = []
    texts = [" ".join(f"w{i * 7 % 1000}" for i in range(2000))] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    with pytest.MonkeyPatch.context() as m:
        real = op1.anchors
        m.setattr(op1, "anchors", lambda p, *a: seen.append(len(p)) or real(p, *a))
        op1.anchors_of(batch, [op1.Kind(51 * op1.WORD_BYTES, 16 * op1.WORD_BYTES, True)])
    assert seen == [3 * 2000 + 1]


def test_suffix_merged():
    r = random.Random(8)
    spans = [(r.randrange(6), a, a + r.randint(1, 9)) for a in (r.randrange(60) for _ in range(60))]
    want = []
    for row in range(6):
        hit = np.zeros(80, bool)
        for i, a, b in spans:
            if i == row:
                hit[a:b] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(int)))
        want += [(row, a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
    assert list(zip(*(x.tolist() for x in op1.merged(*np.array(spans).T)))) == want
    assert [len(x) for x in op1.merged(*np.zeros((3, 0), int))] == [0, 0, 0]


def test_suffix_edges(spark):
    d = docs_of(spark, EDGE)
    assert op1.dedup(d).count() == len(EDGE) and op1.dedup(d.limit(0)).count() == 0
    twice = d.where("doc_id = 7")
    assert {x.n_removed for x in op1.dedup(twice.unionByName(twice)).collect()} == {15_000}
    kept = op1.clean(docs_of(spark, ["é" * 400 + " own", "é" * 400 + " mine", None]))
    assert kept.columns == d.columns and [x.text for x in kept.orderBy("doc_id").collect()] == ["own", "mine", None]
    # a null id, a string id, and texts that one id has twice
    same, other = "s" * 900, "o" * 500
    rows = [(None, same), ("1", same), ("1", other), (None, other + "x"), (None, None)]
    got = op1.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((x.doc_id or "", x.n_bytes, x.n_removed) for x in got) == [("", 0, 0), ("", 501, 500), ("", 900, 900), ("1", 500, 500), ("1", 900, 900)]


# ---- 2: near copies -----------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts, percent=85):
    s = [shingles(t) for t in texts]
    par = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = find(par, i), find(par, j)
                par[max(a, b)] = min(a, b)
    return [(len(s[i]), find(par, i)) for i in range(len(s))]


def family(r, n, size, edits):
    base = [f"w{r.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"e{r.randint(0, 40)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    r = random.Random(5)
    texts = [*EDGE, *family(r, 60, 150, 5), *family(r, 12, 40, 2), *family(r, 5, 8, 1), "a b c", "A  b\tC"]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in op2.near_duplicates(docs_of(spark, texts)).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_rest_is_exact_without_stars(spark):
    r = random.Random(6)
    texts = family(r, 80, 120, 6)
    got = {x.doc_id: x.component_id for x in op2.near_duplicates(docs_of(spark, texts), star_rounds=0).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_near_duplicates_edges(spark):
    assert op2.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    d = docs_of(spark, ["one two three", "one two three"], ids=[4, 4])
    assert [(x.doc_id, x.component_id, x.kept) for x in op2.near_duplicates(d).collect()] == [(4, 4, True)] * 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 20, 400):
        est, true = [], []
        for _ in range(40):
            u = rng.integers(0, 2**63, size=2 * n).astype(np.uint64)
            a, b = np.unique(u[:n]), np.unique(np.concatenate([u[: n // 2], u[n : 2 * n - n // 2]]))
            s = op2.signatures([a, b])
            est.append((s[0] == s[1]).mean())
            true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(est) - np.mean(true)) < 0.03


def test_permutations_are_permutations():
    v = np.arange(50, dtype=np.uint64)
    cells = 12
    swaps, seen = [], []
    for j in range(cells):
        z = H.mix(v + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z & np.uint64(0xFFFFFF)) * np.uint64(cells - j) >> np.uint64(24)).astype(np.int64)
        cell = k
        for i in range(j - 1, -1, -1):
            cell = np.where(cell == swaps[i], i, cell)
        swaps.append(k)
        seen.append(cell)
    assert (np.sort(np.array(seen), axis=0) == np.arange(cells)[:, None]).all()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x1c\x85é", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    b = pa.record_batch({"text": pa.array(texts, pa.string())})
    w, at = H.word_hashes(*H.buffers(b))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert len(set(zip(flat, w.tolist()))) == len(set(flat)) == len(set(w.tolist()))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(1500, 1550)]
    par = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(par, a), find(par, b)
        par[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in C.components(C.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(par, x) for e in edges if e[0] != e[1] for x in e}


# ---- 3: SentencePiece ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return op3.model(SP), sentencepiece.SentencePieceProcessor(model_file=SP)


@given(st.text(alphabet="   ▁abtheinoTr.\n,1é日𐍈—'\"<>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_sentencepiece(pieces, text):
    mine, lib = pieces
    ids = lib.encode(text, add_eos=True)
    assert mine.encode(text) == ids and mine.decode(ids) == lib.decode(ids)
    assert mine.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_sentencepiece_corpus(spark, sf_dir, pieces):
    mine, lib = pieces
    d = C.read(spark, sf_dir, "documents")
    got = {x.doc_id: (x.n_tokens, x.ids_sha256) for x in QUERIES["op3_sentencepiece"](spark, sf_dir).collect()}
    for x in d.collect():
        ids = lib.encode(x.text or "", add_eos=True)
        assert got[x.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    t = op3.encode_table(docs_of(spark, [*EDGE, " " * 300 + "x", "a" * 4000]), SP)
    assert all(x.decoded == ("" if x.ids == [mine.eos] else lib.decode(list(x.ids))) for x in t.collect())


# ---- 4: Ogg -------------------------------------------------------------------------------


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_checksum(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else (r << 1) & 0xFFFFFFFF
    assert op4.checksum(data) == r


@pytest.mark.parametrize("n", [64, 255 * 64, 4096, 4096 * 15, 4096 * 16, 65025 * 64 // 16])
def test_ogg_round_trip(n):
    payload = random.Random(n).randbytes(n // 64 * 64)
    streams = op4.read(op4.write(payload))
    assert op4.samples(streams) == payload and streams[op4.SAMPLES].timestamps[-1] == len(payload) / op4.RATE


def test_ogg_damage():
    media = op4.write(bytes(range(256)) * 64)
    for at in (3, 100, 500, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(op4.OggError):
            op4.read(bytes(bad))
    with pytest.raises(op4.OggError):
        op4.read(media[:-10])
    pages = [p for p in re.split(b"(?=OggS)", media) if p]
    with pytest.raises(op4.OggError):
        op4.read(b"".join(pages[:2] + pages[3:]))


def test_packet_over_pages():
    w = op4.StreamWriter(9)
    data = random.Random(1).randbytes(255 * 600)
    media = b"".join(p.pack() for p in w.pages([(b"head", 0)], op4.BEGIN) + w.pages([(data, 5), (b"", 6)], last=True))
    s = op4.read(media)[9]
    assert s.packets == [b"head", data, b""] and s.granule == 6


def test_media_table(spark):
    for x in op4.media_table(docs_of(spark, EDGE)).collect():
        raw = (EDGE[x.doc_id] or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert op4.samples(op4.read(bytes(x.media))) == payload and x.media_sha256 == hashlib.sha256(bytes(x.media)).hexdigest()


# ---- 5: pages -----------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header class="top">Site</header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Big &amp; news</h1><p>First <b>bo</b>ld.<p>Sec&#111;nd &copy
<div class="share">Share me</div><aside>Side</aside><form>Name <input></form><ul><li>One<li>Two</ul><div id="comments"><p>I agree</p></div></article></main><footer>Foot</footer>"""


def test_blocks():
    assert " ".join(s for s, _ in op5.blocks(PAGE)) == "Big & news First bold. Second © One Two"
    assert op5.blocks(None) == [] == op5.blocks("") and [s for s, _ in op5.blocks("plain <b>text")] == ["plain text"]
    assert [s for s, _ in op5.blocks("<div><a>menu link</a></div><div>Real words are here <a>x</a></div>")] == ["Real words are here x"]


def test_template_goes_and_copies_stay(spark):
    body = lambda i: f"<html><body><article><p>Story {i} " + " ".join(f"w{i}x{j}" for j in range(30)) + "</p><p>Read all our other stories tonight</p></article></body></html>"
    same = "<article><p>" + " ".join(f"c{j}" for j in range(40)) + "</p></article>"
    rows = [(i, f"http://a.example/{i}", body(i)) for i in range(6)] + [(10 + i, "https://b.example:80/x", same) for i in range(4)] + [(20, None, None), (21, "nohost", "")]
    got = {x.page_id: x.text for x in op5.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Read all" not in got[i] and got[i].startswith(f"Story {i} ") for i in range(6))
    assert all(got[10 + i].startswith("c0 c1") for i in range(4)) and got[20] == got[21] == ""
    few = op5.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=3)
    assert {x.page_id: x.text for x in few.collect()} == got
    # boilerplate that outweighs short articles, whatever the shards; null and string ids
    stub = lambda i: f"<article><p>Note {i} q{i}</p>" + "".join(f"<p>{' '.join(f't{k}x{j}' for j in range(20))}</p>" for k in range(4)) + "</article>"
    rows = [(str(i) if i else None, f"http://s.example/{i}", stub(i)) for i in range(40)] + [("x", "http://s.example/x", stub(1))] * 30
    for shard in (500, 7):
        got = op5.extract(spark.createDataFrame(rows, "page_id string, url string, html string"), shard=shard).collect()
        assert sorted(x.text for x in got) == sorted([f"Note {i} q{i}" for i in range(40)] + ["Note 1 q1"] * 30) and any(x.page_id is None for x in got)


@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_suffix_array(stream):
    n = len(stream)
    a = op5.SuffixArray(np.array(stream))
    order = sorted(range(n), key=lambda i: stream[i:])
    prefix = lambda x, y: next((k for k, (p, q) in enumerate(zip(stream[x:], stream[y:])) if p != q), n - max(x, y))
    assert a.order.tolist() == order and a.common.tolist() == [0, *(prefix(x, y) for x, y in zip(order, order[1:]))]
    owner = [i * 3 // n for i in range(n)]
    want = [max([prefix(i, j) for j in range(n) if owner[i] != owner[j]], default=0) for i in range(n)]
    assert a.shared(np.array(owner)).tolist() == want


class Article(html.parser.HTMLParser):
    """Text of the article element, block by block, without the parts that are none of it: another way to the same text."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "div", "br", "article", "section", "blockquote", "td", "tr", "table", "pre"}
    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.now = 0, [], []

    def cut(self):
        self.out.append(" ".join("".join(self.now).split()))
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in self.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def test_extraction_against_a_plain_parser(spark, sf_dir):
    """Every page of the table: no host of it has boilerplate within its articles."""
    got = {x.page_id: x.text for x in QUERIES["op5_html"](spark, sf_dir).collect()}
    same = 0
    for x in C.read(spark, sf_dir, "pages").collect():
        p = Article()
        p.feed(x.html or "")
        p.cut()
        same += got[x.page_id] == " ".join(s for s in p.out if s)
    assert same == len(got)


def test_boilerplate_against_brute_force(spark):
    r = random.Random(11)
    common = [" ".join(f"c{k}w{j}" for j in range(r.randint(2, 9))) for k in range(6)]
    rows = []
    for i in range(60):
        own = [" ".join(f"o{r.randrange(10**6)}" for _ in range(r.randint(2, 12))) for _ in range(r.randint(1, 4))]
        parts = own + [c for k, c in enumerate(common) if r.random() < (k + 1) / 7]
        r.shuffle(parts)
        rows.append((i, f"http://h{i % 2}.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>", parts))
    rows += [(100 + i, "http://h0.example/c", rows[0][2], rows[0][3]) for i in range(5)]
    want = {}
    for host in ("h0", "h1"):
        mine = [x for x in rows if f"//{host}." in x[1]]
        pages = {tuple(x[3]) for x in mine}
        on = collections.Counter(b for p in pages for b in set(p))
        gone = {b for b, n in on.items() if n >= 3 and n >= len(pages) / 2}
        want |= {x[0]: " ".join(b for b in x[3] if b not in gone) for x in mine}
    df = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string")
    for shard in (500, 9):
        assert {x.page_id: x.text for x in op5.extract(df, shard=shard).collect()} == want


def test_runs_inside_blocks(spark):
    """Blocks half boilerplate, half own, which counting equal blocks leaves; runs over block ends; near copies are no evidence."""
    own = lambda i, k, n=9: " ".join(f"o{i}x{k}y{j}" for j in range(n))
    lead, tail = " ".join(f"lead{j}" for j in range(10)), [" ".join(f"t{k}z{j}" for j in range(5)) for k in range(2)]
    seven = " ".join(f"short{j}" for j in range(7))
    rows, want = [], {}
    for i in range(40):
        parts = [f"{own(i, 0)} {lead} {own(i, 1)}", f"{seven} {own(i, 2)}", *([f"{own(i, 3)} {tail[0]}", f"{tail[1]} {own(i, 4)}"] if i % 3 else [own(i, 5)])]
        rows.append((i, f"http://a.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"))
        want[i] = " ".join([own(i, 0), own(i, 1), parts[1], *([own(i, 3), own(i, 4)] if i % 3 else [own(i, 5)])])
    article = " ".join(f"same{j}" for j in range(200))
    for i in range(40, 46):  # a host of near copies
        text = f"{article} edit{i} {article[::-1]}"
        rows.append((i, f"http://b.example/{i}", f"<article><p>{text}</p></article>"))
        want[i] = text
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (500, 7):
        assert {x.page_id: x.text for x in op5.extract(df, shard=shard).collect()} == want


@given(st.lists(st.lists(st.lists(st.integers(1, 2), max_size=6), max_size=3), min_size=2, max_size=5), st.integers(2, 3))
@settings(max_examples=120, deadline=None)
def test_longest_runs_of_many_pages(pages, count):
    host = op5.Host(pages)
    owner, raw = host.owner, host.flat.tolist()
    got = host.array.shared_by(owner, count)
    for i in range(len(raw)):
        best = max((n for n in range(1, len(raw) - i + 1) if len({int(owner[j]) for j in range(len(raw) - n + 1) if raw[j : j + n] == raw[i : i + n]}) >= count), default=0)
        assert got[i] == best


@given(st.lists(st.lists(st.lists(st.integers(1, 3), max_size=5), max_size=3), min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_repeated_blocks(pages):
    whole = op5.repeated_blocks(op5.Host(pages), 3)
    streams = [[x for b in p for x in (0, *b)] + [0] for p in pages]
    grams = collections.defaultdict(set)
    for i, s in enumerate(streams):
        for k in range(len(s) - 2):
            grams[tuple(s[k : k + 3])].add(i)
    want = []
    for i, (s, p) in enumerate(zip(streams, pages)):
        hit = [False] * len(s)
        for k in range(len(s) - 2):
            if len(grams[tuple(s[k : k + 3])]) > 1:
                hit[k : k + 3] = [True] * 3
        at = 1
        for b in p:
            want.append(all(hit[at : at + len(b)]))
            at += len(b) + 1
    assert list(whole) == want


# ---- 6: personal data ---------------------------------------------------------------------


@given(st.text(alphabet="ab.@-+ é1%()4", max_size=40))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    want = [(k, m.start(), m.end()) for k in op6.KINDS for m in op6.PATTERNS[k].finditer(text) if op6.valid(k, m[0])]
    assert op6.base_spans(text) == sorted(want, key=lambda s: (s[1], op6.KINDS.index(s[0])))


def test_gradient():
    t = op6.Tagger(1, 4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = op6.labelled_windows(3, 9)
    x, y = x[:, :12], y[:, :12]
    _, g = t.gradient(x, y)
    rng = np.random.default_rng(0)
    for k in t.p:
        i = tuple(rng.integers(0, n) for n in t.p[k].shape)
        i = (x[0, 3], i[1]) if k.startswith("wx") else i
        o = t.p[k][i]
        t.p[k][i] = o + 1e-2
        a = t.gradient(x, y)[0]
        t.p[k][i] = o - 1e-2
        b = t.gradient(x, y)[0]
        t.p[k][i] = o
        assert abs((a - b) / 2e-2 - g[k][i]) < 1e-2 * max(1, abs(g[k][i]))


def test_tagger_held_out():
    for kind, (precision, recall) in op6.evaluate(op6.trained(), 300, 99).items():
        assert precision > 0.85 and recall > 0.85, kind


ADDED = [
    ("call (608) 555-0659 now", [("phone", 5, 19)]), ("host 10.2.3.4 or a.b@c.org", []), ("write to john.smith(at)mail.com today", [("email", 9, 31)]),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thou', [("secret", 9, 49)]), ("of 2024-05-06, version 3.1, page 12", []), ("", []), ("no trigger here", []),
]


def test_added_spans():
    m = op6.trained()
    for (text, want), (base, spans) in zip(ADDED, op6.all_spans(m, [t for t, _ in ADDED])):
        assert base == op6.base_spans(text) and set(base) <= set(spans) and [s for s in spans if s not in base] == want


def naive_spans(m, text):
    """One window at a time, and a Viterbi pass in plain Python."""
    hits = [x.start() for x in op6.TRIGGER.finditer(text)]
    last = max(0, -(-(len(text) - op6.WINDOW) // op6.STRIDE))
    near = sorted({min(max(h // op6.STRIDE + k, 0), last) for h in hits for k in (-2, -1, 0, 1)})
    x, out = op6.classes(text), []
    while near:
        n = 1
        while n < len(near) and near[n] == near[n - 1] + 1:
            n += 1
        run, near = near[:n], near[n:]
        begin, end = run[0] * op6.STRIDE, min(len(x), run[-1] * op6.STRIDE + op6.WINDOW)
        total, weight = np.zeros((end - begin, op6.TAGS)), np.zeros(end - begin)
        for k in run:
            part = x[k * op6.STRIDE : k * op6.STRIDE + op6.WINDOW]
            e = m.scores(np.pad(part, (0, op6.WINDOW - len(part)))[None])[:, 0]
            for j in range(len(part)):
                w = 1 + min(j, op6.WINDOW - 1 - j)
                total[k * op6.STRIDE - begin + j] += w * e[j]
                weight[k * op6.STRIDE - begin + j] += w
        e, tr = total / weight[:, None], m.p["tr"]
        best, back = list(e[0]), []
        for row in e[1:]:
            back.append([max(range(op6.TAGS), key=lambda p: best[p] + tr[p][t]) for t in range(op6.TAGS)])
            best = [best[p] + tr[p][t] + row[t] for t, p in enumerate(back[-1])]
        tags = [int(np.argmax(best))]
        for b in reversed(back):
            tags.insert(0, b[tags[0]])
        at = 0
        while at < len(tags):
            start, tag = at, tags[at]
            at += 1
            if tag:
                kind = (tag - 1) // 2
                while at < len(tags) and tags[at] == 2 + 2 * kind:
                    at += 1
                out.append((op6.TAGGED[kind], begin + start, begin + at))
    return out


def test_batched_decoding_equals_single_windows():
    m = op6.trained()
    r = random.Random(3)
    texts = ["", "x" * 700, *(" ".join(["".join(s for s, _ in op6._planted(r)) if r.random() < 0.4 else "word" * r.randint(1, 9) for _ in range(r.randint(1, 40))]) for _ in range(25)), "7 " * 300]
    assert m.spans(texts) == [naive_spans(m, t) for t in texts]


def test_pii_table(spark):
    m = op6.trained()
    d = docs_of(spark, [*EDGE, "mail me at x.y@z.com or +1 (608) 555-0659", "key=" + "7c" * 16 + " end"])
    got = {x.doc_id: x for x in op6.find(d, m).collect()}
    last = got[len(EDGE)]
    assert (last.n_email, last.n_phone, last.n_spans) == (1, 1, 2) and last.spans == "email:11:20,phone:24:41"
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[len(EDGE) + 1].secrets == "secret:4:36"
    out = op6.redact(d, m)
    assert out.columns == d.columns and out.where("text is null").count() == 1
    assert [x.text for x in out.where(f"doc_id >= {len(EDGE)}").orderBy("doc_id").collect()] == ["mail me at [EMAIL] or [PHONE]", "key=[SECRET] end"]
    ids = spark.createDataFrame([(None, "a@b.cc"), ("s", None)], "doc_id string, text string")
    assert {(x.doc_id, x.n_email) for x in op6.find(ids, m).collect()} == {(None, 1), ("s", 0)}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["john", "a1", "x.y"]), st.sampled_from(["@", "[at]", " (AT) ", " at ", " At "]), st.sampled_from([".", " dot ", "[dot]", " (DOT) "]), st.sampled_from(["example", "b-c"]), st.sampled_from(["com", "x"]))
def test_pii_gate_lets_every_accepted_email_through(user, at, dot, host, top):
    s = f"{user}{at}{host}{dot}{top}"
    assert not op6.SHAPES["email"].match(s) or op6.TRIGGER.search(f"mail {s} now")


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["ip", "card", "phone", "secret"]), st.text(alphabet="0aF:.-+() ", min_size=2, max_size=24))
def test_pii_gate_lets_every_accepted_span_through(kind, s):
    assert not op6.accepted(kind, s) or op6.TRIGGER.search(f"x {s} y")


def test_pii_gate_addresses_without_digits():
    assert op6.accepted("ip", "dead:beef::cafe") and op6.TRIGGER.search("on dead:beef::cafe") and op6.TRIGGER.search("john at example.com") and not op6.TRIGGER.search("be at home. then: go")


def test_pii_long_texts_take_linear_time():
    texts = ["1" * 5000 + ".1.1.1", "1" * 100_000, "1." * 50_000, "+1" + "(" * 100_000, "a@" * 50_000, "9 " * 50_000, "a" * 100_000 + "@b", "00000000000255.0.0.1"]
    t = time.process_time()
    got = [op6.base_spans(x) for x in texts]
    assert time.process_time() - t < 3 and got[0] == [] and got[-1] == [("ip", 0, 20)] and len(got[2]) == 12_500


# ---- 7: language model --------------------------------------------------------------------


def test_lm_base(spark, sf_dir):
    tok = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    rows = C.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    c = collections.Counter(w for x in rows if zlib.crc32(str(x.doc_id).encode()) % 7 != 2 for w in tok(x.text))
    n, v = sum(c.values()), len(c)
    got = QUERIES["op7_lm"](spark, sf_dir).collect()
    text = {x.doc_id: x.text for x in rows}
    for x in got:
        k = tok(text[x.doc_id])
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(k), sum(c[w] > 0 for w in k), n, zlib.crc32(str(x.doc_id).encode()) % 7 == 2)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in k), rel_tol=1e-9, abs_tol=1e-9)
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


@pytest.mark.parametrize("words", [3, 254, 255, 300, 5000])
def test_lm_is_a_distribution(words):
    """Over all words of the table, the end, and the words outside together, in any context."""
    top = [(b"w%d" % i, 9000 // (i + 1)) for i in range(words)]
    t = op7.Table(top, sum(n for _, n in top) + 30, words + 8, 10)
    rng = np.random.default_rng(0)
    for w in t.weights():
        w += rng.standard_normal(w.shape).astype(np.float32)
    for ctx in ([], [b"w1"], [b"nowhere", b"w2"]):
        texts = [" ".join(x.decode() for x in [*ctx, w]) for w in [*t.ids, b"elsewhere"]] + [" ".join(x.decode() for x in ctx)]
        e = t.events(*t.encode(texts))
        p = 10 ** t.log10(e)[np.append(e.starts[1:-1], len(e.sym) - len(ctx) - 1) - 2]
        end = 10 ** t.log10(e)[-1]
        assert abs(p.sum() + end - 1) < 1e-3


def test_lm_score_against_plain_python(spark):
    """The sums of the model's log10 probabilities, choice by choice from the weights."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, [(i + 1) ** -0.5 for i in range(400)], k=r.randint(0, 160))) for _ in range(40)]
    d = docs_of(spark, texts + [None, "unseen w3 " + "z" * 50])
    counts = C.Scratch(spark, "t").save(op7.count_tokens(d.where("doc_id < 40")))
    t = op7.fit(d.where("doc_id < 40"), counts)
    n = {bytes(x.token): x.n for x in counts.collect()}
    assert t.rest_total == 0 and len(t.ids) == len(n) - 1 and float(abs(t.w3).max()) > 0
    mask = (1 << 64) - 1
    k = [int(x) for x in op7._K]

    def choice(z, child):
        z = z.astype(np.float64)
        return (z[child] - np.log(np.exp(z).sum())) / np.log(10)

    def score(text):
        total, ctx = 0.0, [0, 0]
        for w in [*op7.tokens(text), None]:
            i = t.ids.get(w, -1) if w is not None else None
            sym = op7.END if w is None else i if 0 <= i < t.words else op7.RARE
            one, two = ctx[-1], ctx[-2]
            f = [((one + 7) * k[0] & mask) >> 64 - t.feature_bits, ((two + 9) * k[1] & mask) >> 64 - t.feature_bits]
            f.append(((((one * k[1] & mask) ^ two) * k[2] & mask) ^ (two * k[0] & mask)) * k[1] % (mask + 1) >> 64 - t.feature_bits)
            f = [x + (j << t.feature_bits) for j, x in enumerate(f)]
            cls = sym // 16
            total += choice(t.b1 + sum(t.w1[x] for x in f), cls) + choice(t.b2[cls] + sum(t.w2[x * 16 + cls] for x in f), sym % 16)
            if sym == op7.RARE:
                leaf = i - t.words if i >= 0 else op7.UNLISTED
                hashed = [(one + 7) * k[0] & mask, (two + 9) * k[1] & mask]
                for level in range(4):
                    node = [0, 1, 17, 273][level] + leaf // 16 ** (4 - level)
                    row = ((hashed[level % 2] ^ (node * k[2] & mask)) * k[0] & mask) >> 64 - t.deep_bits
                    total += choice(t.b3[node] + t.w3[row], leaf // 16 ** (3 - level) % 16)
            if w is not None and i < 0:
                total += math.log10(n.get(w, 0) + 1) - math.log10(t.rest_total + t.rest_distinct + 1)
            ctx.append(1 if w is None else i + 2 if i >= 0 else zlib.crc32(w) % op7.UNSEEN + len(t.ids) + 2)
        return total

    for x in op7.score(d, t, counts).collect():
        assert math.isclose(x.score, score((texts + ["", "unseen w3 " + "z" * 50])[x.doc_id]), rel_tol=1e-4, abs_tol=1e-3)


def test_lm_edges(spark):
    d = docs_of(spark, EDGE)
    counts = C.Scratch(spark, "t").save(op7.count_tokens(d))
    out = op7.score(d, op7.fit(d, counts), counts)
    assert out.count() == len(EDGE) and out.where("isnan(score) or score > 0").count() == 0
    none = d.limit(0)
    empty = C.Scratch(spark, "t").save(op7.count_tokens(none))
    got = op7.score(d, op7.fit(none, empty), empty)
    assert got.where("base_score = 0 and n_known = 0 and train_tokens = 0").count() == len(EDGE)


# ---- 8: quality ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name])


def test_quality_rules(spark):
    words = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    texts = [words("a", 60), words("b", 10), "x y z " * 30, *[words(f"u{i}", 20) + "\n" + words("tpl", 80) for i in range(8)], *[words("copy", 90) + "\nend of it"] * 8, *EDGE]
    got = op8.judge(docs_of(spark, texts), max_docs=5).orderBy("doc_id").collect()
    assert [x.kept for x in got[:3]] == [True, False, False] and got[2].n_repeat_words == 90
    assert not any(x.kept for x in got[3:11]) and all(x.kept for x in got[11:19])
    kept = op8.keep(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, texts).columns and kept.where("doc_id = 0").count() == 1
    plan = op8.judge(docs_of(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("shared", [1, 2, 5, 20])
def test_depleted_documents(spark, shared):
    r = random.Random(shared)
    lines = [" ".join(f"s{i}w{j}" for j in range(200 // shared)) for i in range(shared)]
    own = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    texts = ["\n".join([*lines, own(i, 12)]) for i in range(300)]
    got = op8.judge(docs_of(spark, texts)).collect()
    assert {(x.kept, x.n_boilerplate_words, x.n_words) for x in got} == {(False, 200, 212)}
    # copies of one text are one document; near copies that are few in a large host stay
    assert all(x.kept for x in op8.judge(docs_of(spark, [texts[0]] * 300)).collect())
    base = [own(9999, 8).replace("x", f"y{k}x") for k in range(10)]
    near = []
    for i in range(130):
        copy = list(base)
        copy[r.randrange(10)] += f" edit{i}"
        near.append("\n".join(copy))
    near += [own(i, 60) for i in range(1500)]
    assert all(x.kept for x in op8.judge(docs_of(spark, near)).collect())
    # five documents are within the limit, six are not; ids that are null or strings
    for n in (5, 6):
        d = docs_of(spark, texts[:n]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id").cast("string")))
        got = op8.judge(d).collect()
        assert len(got) == n and {x.kept for x in got} == {n == 5} and op8.clean(d).count() == op8.keep(d).count() == (n if n == 5 else 0)


def test_quality_stage_removes_lines(spark, sf_dir):
    import corpus_pipeline as cp

    words = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    tpl = "Read  More\tHere"
    texts = [f"{words(f'a{i}x', 30)}\n{tpl}\n\n{words(f'b{i}x', 30)}\n read more HERE \n" for i in range(120)]
    want = [t.replace(tpl + "\n", "").replace(" read more HERE \n", "") for t in texts]
    docs = docs_of(spark, texts)
    assert {x.n_boilerplate_words for x in op8.judge(docs).collect()} == {6}
    out = cp.quality(spark, docs, sf_dir)
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert out.columns == docs.columns and [got[i] for i in range(120)] == [(t, len(t)) for t in want]
    # five documents of a host are within the limit, however few it has
    for d in (docs.limit(5), docs.withColumn("source", (F.col("doc_id") / 5).cast("int").cast("string"))):
        assert {x.text for x in cp.quality(spark, d, sf_dir).collect()} <= set(texts)
    plan = op8.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---- 9: packing ---------------------------------------------------------------------------


@given(st.text(alphabet="   abtheino.\n\t\r,1é²½'sreß<>|×÷\xa0\xad😀", max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids(text):
    e = op9.encoder(BPE)
    assert list(memoryview(e.encode(text)).cast("I")) == e.library.encode(text, add_special_tokens=False).ids


def test_special_text():
    e = op9.encoder(BPE)
    assert list(memoryview(e.encode("a<|endoftext|>b")).cast("I")) == e.library.encode("a<|endoftext|>b", add_special_tokens=False).ids


def check_packing(spark, d, parts):
    e = op9.encoder(BPE)
    ids = {x.doc_id: [*e.library.encode(x.text or "", add_special_tokens=False).ids, 0] for x in d.collect()}
    rows = op9.pack(d.repartition(parts, "doc_id"), BPE).collect()
    back, seq = collections.defaultdict(dict), collections.defaultdict(dict)
    for x in rows:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and x.doc_tokens == len(ids[x.doc_id])
        back[x.doc_id][x.start] = list(x.ids)
        seq[x.sequence_id][x.offset] = x.length
    assert {k: [i for s in sorted(v) for i in v[s]] for k, v in back.items()} == ids
    padding = 0
    for v in seq.values():
        at = 0
        for o in sorted(v):
            assert o == at
            at += v[o]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, sum(map(len, ids.values())))


def test_packing(spark, sf_dir):
    d = C.read(spark, sf_dir, "documents")
    assert check_packing(spark, d, 7) == 0
    check_packing(spark, docs_of(spark, EDGE), 3)
    assert op9.pack(docs_of(spark, ["x"]).limit(0), BPE).count() == 0


# ---- 10: languages ------------------------------------------------------------------------


def test_language(spark, sf_dir):
    lang = {x.doc_id: x.lang for x in C.read(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    got = [x for x in QUERIES["op10_language"](spark, sf_dir).collect() if x.held_out and x.lang_pred != "und"]
    assert np.mean([lang[x.doc_id] == x.lang_pred for x in got]) > 0.95 and all(0 <= x.score <= 1 for x in got)


def test_language_edges(spark):
    d = docs_of(spark, [*EDGE, "123 !!"])
    m = op10.fit(d.where("doc_id > 3"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in op10.predict(d, m).collect()}
    assert got[0] == got[1] == got[len(EDGE)] == ("und", 0.0) and got[5][0] == "en"
    # no row, no label, and labels of texts without a letter
    for few in (d.limit(0), d.withColumn("lang", F.lit(None).cast("string")), d.where("doc_id < 4"), d.where("text = '123 !!'")):
        assert {x.lang_pred for x in op10.predict(d, op10.fit(few)).collect()} == {"und"}
    nulls = spark.createDataFrame([(None, "hola"), ("k", None)], "doc_id string, text string")
    assert sorted((x.doc_id or "", x.lang_pred) for x in op10.predict(nulls, m).collect()) == [("", "en"), ("k", "und")]


def test_language_equals_plain_updates():
    """Weights and temperature of the sparse training against the same rule, coordinate by coordinate."""
    r = random.Random(6)
    texts = [("".join(r.choice("abcde ") for _ in range(40)), 0) if i % 2 else ("".join(r.choice("cdefg ") for _ in range(40)), 1) for i in range(30)]
    rows = [(np.flatnonzero(c), c[np.flatnonzero(c)], y) for t, y in texts for c in [op10.ngram_counts(t)]]
    idf = np.linspace(1, 2, op10.BUCKETS)
    m = op10.train(rows, ["x", "y"], idf, epochs=2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(b, k):
        if abs(z[b, k]) <= op10.L1:
            return 0.0
        return -(z[b, k] - math.copysign(op10.L1, z[b, k])) / ((op10.BETA + math.sqrt(n[b, k])) / op10.ALPHA + op10.L2)

    def features(at, c):
        v = [math.log1p(x) * idf[b] for b, x in zip(at.tolist(), c.tolist())]
        long = math.sqrt(sum(x * x for x in v))
        return [*((b, x / long) for b, x in zip(at.tolist(), v)), (op10.BUCKETS, 1.0)]

    fit_rows = [x for i, x in enumerate(rows) if i % 5]
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(fit_rows)):
            at, c, y = fit_rows[i]
            f = features(at, c)
            w = {(b, k): weight(b, k) for b, _ in f for k in (0, 1)}
            s = [sum(x * w[b, k] for b, x in f) for k in (0, 1)]
            e = [math.exp(v - max(s)) for v in s]
            for b, x in f:
                for k in (0, 1):
                    g = x * (e[k] / sum(e) - (k == y))
                    step = (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / op10.ALPHA
                    z[b, k] += g - step * w[b, k]
                    n[b, k] += g * g
    for b in {b for at, _, _ in rows for b in at.tolist()}:
        assert np.allclose(m.weights[b], [weight(b, 0), weight(b, 1)], atol=1e-6)
    assert np.allclose(m.bias, [weight(op10.BUCKETS, 0), weight(op10.BUCKETS, 1)], atol=1e-6) and 0.05 <= m.temperature <= 5


# ---- the pipeline -------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = C.read(spark, sf_dir, "documents")
    s = C.Scratch(spark, "t")
    kept = {}
    for name, f in cp.STAGES[:-1]:
        docs = s.save(f(spark, docs, sf_dir))
        kept[name] = docs
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    full = {x.doc_id: x.text for x in C.read(spark, sf_dir, "documents").collect()}
    want = {x.doc_id for x in op8.judge(C.read(spark, sf_dir, "documents")).where("kept").collect()}
    left = {x.doc_id: x.text for x in kept["quality"].collect()}
    assert set(left) == want
    # a line on more than five documents of a host and more than a tenth of them is cut
    norm = lambda t: [(x, " ".join(y for y in re.split(r"[\x20\x09-\x0D]+", x) if y).lower()) for x in (t or "").split("\n")]
    host = {x.doc_id: x.source or "" for x in C.read(spark, sf_dir, "documents").select("doc_id", "source").collect()}
    pages, held = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in full.items():
        page = tuple(y for _, y in norm(t) if y)
        pages[host[i]].add(page)
        for y in page:
            held[host[i], y].add(page)
    over = {k for k, v in held.items() if len(v) > 5 and 10 * len(v) > len(pages[k[0]])}
    assert left == {i: "\n".join(x for x, y in norm(full[i]) if not y or (host[i], y) not in over) if any((host[i], y) in over for _, y in norm(full[i]) if y) else full[i] for i in want}
    full = left
    order = sorted(want)
    comp = brute_components([full[i] for i in order], 80)
    stay = {order[i] for i, (_, c) in enumerate(comp) if c == i}
    assert {x.doc_id for x in kept["near_dedup"].collect()} == stay
    order = sorted(stay)
    cut = dict(zip(order, brute_words([full[i] for i in order], 51)))
    assert {x.doc_id: x.text for x in kept["suffix_dedup"].collect()} == cut
    m = op6.trained()
    for x in kept["pii"].collect():
        ((_, spans),) = op6.all_spans(m, [cut[x.doc_id]])
        assert (x.text != cut[x.doc_id]) == bool(spans) and x.n_chars == len(x.text)
    rows = cp.run(spark, sf_dir).select("doc_id", "length", "doc_tokens").toPandas()
    assert isinstance(rows, pd.DataFrame) and (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all()
    assert set(rows["doc_id"]) == stay


def test_near_duplicates_of_any_ids(spark, sf_dir):
    """Text ids and null ids: linked as numbers are, the smallest id that isn't null names the component."""
    import corpus_pipeline as cp

    r = random.Random(12)
    texts = [*family(r, 8, 120, 2), *family(r, 5, 60, 1), *EDGE, "own words of this text stand alone here"]
    want = brute_components(texts)
    names = [None if i % 3 == 1 else f"k{(i * 7) % 100:02d}" for i in range(len(texts))]
    for kind, ids in (("string", names), ("long", [x and int(x[1:]) for x in names])):
        d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], f"doc_id {kind}, text string, lang string, source string, n_chars long")
        got = sorted((x.n_shingles, str(x.component_id), str(x.doc_id), x.kept) for x in op2.near_duplicates(d).collect())
        groups = collections.defaultdict(list)
        for i, (_, c) in enumerate(want):
            groups[c].append(i)
        least = {c: min((ids[i] for i in g if ids[i] is not None), default=None) for c, g in groups.items()}
        assert [g[:3] for g in got] == sorted((n, str(least[c]), str(ids[i])) for i, (n, c) in enumerate(want))
        kept = [g for g in got if g[3]]
        assert len(kept) == len(groups) and all(g[1] == g[2] for g in kept)
        out = cp.near_dedup(spark, d, sf_dir)
        assert out.columns == d.columns and out.count() == len(set(c for _, c in brute_components(texts, 80)))
        assert cp.near_dedup(spark, d.limit(0), sf_dir).count() == 0
    for stage in (cp.quality, cp.suffix_dedup, cp.pii):
        assert stage(spark, d, sf_dir).columns == d.columns and stage(spark, d.limit(0), sf_dir).count() == 0
    assert cp.packing(spark, d, sf_dir).where("doc_id is null").count() > 0 and cp.packing(spark, d.limit(0), sf_dir).count() == 0


def test_pipeline_near_copies_from_80_percent(spark, sf_dir):
    import corpus_pipeline as cp

    assert [op2.bands_for(p) for p in (85, 80)] == [op2.BANDS, 35]
    r = random.Random(8)
    texts = [*EDGE, *(t for _ in range(20) for t in family(r, 4, 100, 3)), *family(r, 30, 120, 4)]
    want = brute_components(texts, 80)
    assert want != brute_components(texts, 85)
    got = {x.doc_id for x in cp.near_dedup(spark, docs_of(spark, texts), sf_dir).collect()}
    assert got == {i for i, (_, c) in enumerate(want) if c == i}


def brute_words(texts, words):
    """Bytes of each text that are left when strings of 400 bytes and passages of so many words that also stand elsewhere go."""
    raw = [(t or "").encode() for t in texts]
    found = [[(x.start(), x.group()) for x in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    grams = lambda w: [tuple(x for _, x in w[i : i + words]) for i in range(len(w) - words + 1)]
    seen = collections.Counter(g for w in found for g in grams(w))
    strings = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for b, w in zip(raw, found):
        gone = np.zeros(len(b), bool)
        starts = [i for i, _ in w] + [len(b)]
        for i, g in enumerate(grams(w)):
            if seen[g] > 1:
                gone[starts[i] : starts[i + words]] = True
        for i in range(len(b) - 399):
            if strings[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        out.append(bytes(x for x, c in zip(b, gone) if not c).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_passages_in_words(spark, hot):
    r = random.Random(9)
    own = lambda n: [f"{r.choice('abcdé')}{r.randrange(10**4)}" for _ in range(n)]
    texts = [*EDGE]
    # passages of 50 to 60 words, of short words and of long ones, at the edges and inside of texts
    for n in (50, 51, 52, 55, 60):
        for size in (1, 3, 9):
            p = [(r.choice("xyzü") * size)[:size] + (str(r.randrange(10)) if size > 1 else "") for _ in range(n)]
            for k in range(3):
                texts.append(" ".join([*own(r.randrange(3) * 4), *p, *own(r.randrange(2) * 7)]).replace(" ", "\n" if k == 2 else " "))
    src = [own(150) for _ in range(3)]
    for _ in range(15):
        texts.append(" ".join(x for _ in range(4) for i in [r.randrange(90)] for x in [*r.choice(src)[i : i + r.randint(45, 60)], *own(r.randrange(2))]))
    want = brute_words(texts, 51)
    got = {x.doc_id: x.text or "" for x in op1.clean(docs_of(spark, texts), hot=hot, words=51).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pipeline_passages_of_51_words(spark, sf_dir):
    import corpus_pipeline as cp

    p = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 51), ("q", 60), ("r", 50))]
    texts = [f"own{k}a {x}\nown{k}b" for k, x in enumerate([*p, *p])]
    got = {x.doc_id: (x.text, x.n_chars) for x in cp.suffix_dedup(spark, docs_of(spark, texts), sf_dir).collect()}
    want = [f"own{k}a own{k}b" if k % 3 < 2 else t for k, t in enumerate(texts)]
    assert [got[k] for k in range(6)] == [(t, len(t)) for t in want]


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert F is not None
