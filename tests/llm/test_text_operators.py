"""Fingerprints, pieces, page text, packing, rules and classifier: brute force,
round trips, held-out accuracy, odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from llm_rows import ODD, documents, words  # noqa: F401
from patronage.llm import fingerprint, html_text, packing, pieces, quality_model, quality_rules, registry

# --- fingerprints


def brute_boundaries(data):
    """The chunk rule byte by byte, the hash from its definition."""
    table = [int(x) for x in fingerprint._GEAR]
    out, start = [], 0
    for i in range(len(data)):
        n = i - start + 1
        h = sum(table[data[i - k]] << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
        cut = n >= fingerprint.MAXIMUM
        if n >= fingerprint.MINIMUM:
            bits = fingerprint.STRICT_BITS if n <= fingerprint.AVERAGE else fingerprint.LOOSE_BITS
            if n <= fingerprint.AVERAGE or n >= fingerprint.AVERAGE:
                cut = cut or h >> (32 - bits) == 0
        if cut:
            out.append(i + 1)
            start = i + 1
    return out + ([len(data)] if start < len(data) else [])


def test_chunks_follow_the_rule():
    for seed in range(4):
        data = np.frombuffer(" ".join(words(400, seed)).encode(), dtype=np.uint8)
        got = fingerprint.boundaries(data)
        sizes = np.diff([0, *got])
        assert got[-1] == len(data) and sizes.max() <= fingerprint.MAXIMUM and sizes[:-1].min() >= fingerprint.MINIMUM
        h = fingerprint.gear(data)
        table = [int(x) for x in fingerprint._GEAR]
        for i in (0, 5, 31, 32, 200):
            assert int(h[i]) == sum(table[data[i - k]] << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
        start = 0
        for end in got[:-1]:
            n = end - start
            bits = fingerprint.STRICT_BITS if n <= fingerprint.AVERAGE - 0 and h[end - 1] >> np.uint32(24) == 0 else fingerprint.LOOSE_BITS
            assert n == fingerprint.MAXIMUM or int(h[end - 1]) >> (32 - bits) == 0
            for j in range(start + fingerprint.MINIMUM - 1, min(end - 1, start + fingerprint.AVERAGE)):
                assert int(h[j]) >> (32 - fingerprint.STRICT_BITS) != 0  # no strict boundary was passed over
            start = end


def test_chunks_resist_shifts():
    text = " ".join(words(2000, 3))
    a, b = fingerprint.chunk_set(text), fingerprint.chunk_set("something new in front " + text)
    assert fingerprint.containment(a, b) > 0.97
    assert fingerprint.containment(a, fingerprint.chunk_set(" ".join(words(2000, 4)))) == 0
    again = fingerprint.from_text(fingerprint.as_text(a))
    assert (again[0] == a[0]).all() and (again[1] == a[1]).all()


def brute_edits(rows):
    top = (1 << 63) - 1
    order = sorted(rows, key=lambda r: (-(top if r[0] is None else r[0]), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        a, b, c = (fingerprint.chunk_set(x) for x in (t, new, after))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.as_text(a), fingerprint.as_text(b),
                    fingerprint.containment(a, b), fingerprint.containment(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ODD, [(i * 7 % 101, " ".join(words(30 + i, i))) for i in range(101)], [(4, "alone in the table")], []],
                         ids=["odd", "many", "one", "empty"])
def test_edit_digest_brute_force(documents, rows):
    got = fingerprint.edit_digest(documents(rows, clashing=True)).collect()
    assert sorted(map(tuple, got), key=str) == brute_edits(rows)


def test_fingerprint_columns(documents):
    df = documents([(1, "some text " * 30), (2, None)]).withColumn("f", fingerprint.fingerprint_column(F.col("text")))
    rows = df.withColumn("c", fingerprint.containment_column(F.col("f"), F.col("f"))).collect()
    assert [r["c"] for r in rows] == [1.0, 1.0] and rows[1]["f"] == ""


# --- pieces


def unigram():
    """The library's own unigram encoder over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        p.score = max(p.score, -40_000.0)  # a few of -1e9 swallow all others in the library's 32-bit sums
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_word_by_word(spark):
    """Over whole texts the rounding of its sums may cost the library a better path."""
    own, theirs = pieces.model(MODEL), unigram()
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()]
    for word in {w for t in texts for w in t.split()}:
        assert own.encode(word) == theirs.encode(word), word
    total = lambda ids: sum(theirs.get_score(i) for i in ids)
    for t in texts:
        assert total(own.encode(t)) >= total(theirs.encode(t)) - 1e-6


def test_pieces_commit_early_and_bounded():
    """A text without any known boundary comes out in runs, the same as in one go."""
    m = pieces.model(MODEL)
    text = "".join(words(400, 9))
    runs = list(m.viterbi(text))
    assert len(runs) > 20
    best = [0.0] + [-1e18] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - m.longest), e):
            p = m.pieces.get(text[s:e])
            v = best[s] + (p[1] if p else m.unknown if e - s == 1 else -1e18)
            best[e] = max(best[e], v)
    ids = [i for r in runs for i in r]
    score = {i: s for i, s in m.pieces.values()}
    assert sum(score.get(i, m.unknown) for i in ids) == pytest.approx(best[-1])


def full_table(m, text):
    """The best cut from a table of all boundaries."""
    best, last = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for start in range(len(text)):
        for end in range(start + 1, min(len(text), start + m.longest) + 1):
            p = m.pieces.get(text[start:end])
            score = best[start] + (p[1] if p else m.unknown if end == start + 1 else float("-inf"))
            if score > best[end]:
                best[end], last[end] = score, (start, [p[0]] if p else [m.bytes[b] for b in text[start:end].encode()])
    out, end = [], len(text)
    while end:
        end, ids = last[end]
        out = ids + out
    return out


def test_pieces_equal_a_full_table():
    m, rng = pieces.model(MODEL), random.Random(1)
    for alphabet in ("a", "ab", "=-", "etaoin shrdlu", "aé日x"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 140))).replace(" ", pieces.MARK)
            assert [i for run in m.viterbi(text) for i in run] == full_table(m, text), text


def test_pieces_of_one_letter_in_linear_time():
    """The paths of a run of one letter never meet; four times the text takes about four times as long."""
    m, took = pieces.model(MODEL), []
    for n in (100_000, 400_000):
        began = time.process_time()
        ids = m.encode("a" * n)
        took.append(time.process_time() - began)
        assert m.decode(ids) == "a" * n
    assert took[1] < 10 * took[0] and took[1] < 20


def test_pieces_give_places_back():
    """A long text whose paths meet comes out in short runs."""
    m, rng = pieces.model(MODEL), random.Random(2)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(50_000))
    runs = list(m.viterbi(text))
    assert len(runs) > 5000 and max(map(len, runs)) < 200
    assert "".join(m.surface[i].decode() for run in runs for i in run) == text


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "▁", "a▁ ▁b", "\n\n x\t", "日本語😀", "\x00", "x" * 30_000, " " * 400])
def test_pieces_round_trip(text):
    m = pieces.model(MODEL)
    assert m.decode(m.encode(text)) == text


def test_pieces_digest_and_columns(documents):
    df = documents(ODD, clashing=True)
    got = pieces.encode_digest(df, MODEL).collect()
    assert len(got) == len(ODD) and all(r["round_trip"] for r in got)
    back = df.withColumn("ids", pieces.encode_column(F.col("text"), MODEL)).withColumn("back", pieces.decode_column(F.col("ids"), MODEL))
    assert back.where("back <> coalesce(text, '')").count() == 0
    assert pieces.encode_digest(documents([]), MODEL).count() == 0


# --- page text

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body class="no-sidebar"><header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work. Accept all of them now please, thank you very much.</p></div>
<div id="content" class="with-sidebar"><h1>The &amp; title</h1><p>First paragraph with <b>bold
text</b> and a <a href="/x">link</a>.<br>Same block.<p>Second one &lt;tag&gt; &#233;&nbsp;end</p>
<div class="ad">Buy this now, it is the best thing there is in the whole wide world, really.</div>
<ul><li>item one of the list</li><li>item two of the list</li></ul><p>Yes.</p><form><label>Name</label><input><button>Go</button></form>
<aside>Related: something else entirely that goes on for a while, to look like a paragraph of text.</aside></div>
<section id="comments"><article><p>I think this article is very good, and I have a lot more to say about it, indeed.</p></article></section>
<div class="widget"><p>Popular posts of the week, with a long enough text to look like one of the article.</p></div>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_page_with_everything():
    assert html_text.main_text(PAGE).split("\n") == [
        "The & title", "First paragraph with bold text and a link. Same block.", "Second one <tag> é end",
        "item one of the list", "item two of the list", "Yes.",
    ]


def test_page_without_marks():
    text = [f"Paragraph {i} of the story, long enough to be told from the links around it by its words." for i in range(4)]
    page = "<div><a href=1>Home</a> <a href=2>About</a></div><div><div>" + "".join(f"<p>{t}</p>" for t in text[:2]) + "<p>Short.</p>"
    page += "".join(f"<p>{t}</p>" for t in text[2:]) + "</div></div><div><a href=3>Imprint</a> | <a href=4>Contact</a></div>"
    assert html_text.main_text(page).split("\n") == [*text[:2], "Short.", *text[2:]]


STORY = [f"Paragraph {i} of the story, long enough to be told from what is around it by its words alone, and then some." for i in range(4)]
BESIDE = "<div class='sidebar'><p>Popular posts of the week, with a long enough text to look like one of the article.</p></div>"


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div id='content-sidebar-wrap'><main class='content'>", "</main>SIDE</div>"),
        ("<form id='aspnetForm'><div>", "</div>SIDE</form>"),
        ("<div class='page-with-sidebar'><div>", "</div>SIDE</div>"),
        ("<div class='hentry post comments-open'>", "</div>SIDE"),
        ("<form><div class='page-with-sidebar'>", "</div>SIDE</form>"),
    ],
)
@pytest.mark.parametrize("title", ["The title", ""])
def test_marks_on_wrappers_of_the_page(before, after, title):
    story = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in STORY)
    nav = "<header><p>Site name</p></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>"
    page = f"<body>{nav}{before}{story}{after.replace('SIDE', BESIDE)}<footer>&copy; 2024 Site</footer>"
    assert html_text.main_text(page).split("\n") == [title] * bool(title) + STORY


@pytest.mark.parametrize("name", ["comments-area", "comments", "sidebar-left"])
def test_long_boilerplate_beside_a_short_text(name):
    """Most of the text of the page, but not around its headline and content."""
    other = "".join(f"<p>{t}</p>" for t in STORY * 3)
    for story in ("<article><h1>The title</h1><p>{}</p></article>", "<div><h1>The title</h1><p>{}</p></div>"):
        page = f"<body><main>{story.format(STORY[0])}<div class='{name}'>{other}</div></main>"
        assert html_text.main_text(page).split("\n") == ["The title", STORY[0]]


def test_hidden_text_stays_hidden():
    page = "<div style='display:none'><main><h1>No</h1>" + "".join(f"<p>{t}</p>" for t in STORY) + "</main></div>"
    assert html_text.main_text(page) == ""


def test_open_form_controls_end_with_their_block():
    page = "<form><select><option>A<option>B</select><button>Go</form><p>The text of the page goes on after the form, as it should.</p>"
    assert html_text.main_text(page) == "The text of the page goes on after the form, as it should."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<p a='x", "<script>never closed", "</p></div>", "<p>" * 3000])
def test_broken_pages(page):
    assert html_text.main_text(page) == ""


def test_minimum_cut_is_least():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 8)
        gain = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.2, 0.5, 1.0])) for _ in range(n + 2)]

        def cost(x):
            return -sum(g for g, k in zip(gain, x) if k) + sum(w for i, j, w in edges if x[i] != x[j])

        got = html_text.minimum_cut(gain, edges)
        assert cost(got) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_ORACLE}/pages.parquet").collect()}
    import html

    for r in registry.QUERIES["op6_html_text"](spark, SF_ORACLE).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"])


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>Some words of text in a paragraph that is long enough to count.</p>"), (1, "u", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 63]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_tokenizers(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(VOCABULARY)
    own = packing.encoder(VOCABULARY)
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(50).collect()]
    for t in [*texts, "", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "<<|endoftext|>>", "\n\n  \t", "日本語 😀 don't", "a" * 3000, "\x00 "]:
        assert own(t) == theirs.encode(t, add_special_tokens=False).ids


def check_packed(rows, got, length=2048):
    own = packing.encoder(VOCABULARY)
    expected = []
    for i, t in rows:
        ids = np.array([*own(t or ""), 0], dtype="<u4")
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids), length), len(ids)]
        expected += [(i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return bins


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_packing_odd_rows(documents, rows):
    got = packing.pack_documents(documents(rows, clashing=True), VOCABULARY).collect()
    check_packed(rows, got)


def test_packing_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = registry.QUERIES["op7_best_fit_packing"](spark, SF_SMALL).collect()
    bins = check_packed(rows, got)
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_shards_and_sequences(documents):
    rows = [(i, " ".join(words(20 + i % 90, i))) for i in range(300)]
    packed = packing.pack_documents(documents(rows), VOCABULARY, 256, with_ids=True, shard=50)
    check_packed(rows, [r for r in packed.drop("ids").collect()], 256)
    own = packing.encoder(VOCABULARY)
    joined = b"".join(r["ids"] for r in packing.sequences(packed).collect())
    assert len(joined) == 4 * sum(len(own(t)) + 1 for _, t in rows)


def test_bin_completion_beats_best_fit():
    import random

    sizes = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # best fit: 6+4, 6+4, 5+5, 3+3+2+2
    assert len(packing.bin_completion(sizes, 10)) == 4
    rng, better = random.Random(4), 0
    for _ in range(60):
        sizes = {}
        for _ in range(24):
            s = rng.randrange(20, 71)
            sizes[s] = sizes.get(s, 0) + 1
        plain, got = packing.best_fit(sizes, 100), packing.bin_completion(sizes, 100)
        assert len(got) <= len(plain) and all(sum(b) <= 100 for b in got)
        assert sorted(x for b in got for x in b) == sorted(s for s, n in sizes.items() for _ in range(n))
        better += len(got) < len(plain)
    assert better > 0


def test_bin_completion_of_short_pieces():
    """No piece is near an eighth of the room; a bin holds ten of them at most."""
    sizes = {s: 16_384 // 20 + (s < 195 + 16_384 % 20) for s in range(195, 215)}
    got = packing.bin_completion(sizes, 2048)
    assert all(sum(b) <= 2048 for b in got)
    assert sorted(x for b in got for x in b) == sorted(s for s, n in sizes.items() for _ in range(n))
    assert len(packing.best_fit(sizes, 2048)) > 1700 and len(got) == packing.least_bins(sizes, 2048) == 1639


def test_fillings_are_all_undominated_ones():
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(40):
        pieces = [rng.randrange(2, 15) for _ in range(rng.randrange(1, 9))]
        counts = {s: pieces.count(s) for s in pieces}
        every = {tuple(sorted(c, reverse=True)) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k)}
        every = {f for f in every if sum(f) <= 30}
        wanted = {f for f in every if not any(packing.dominates(x, f) for x in every if x != f)}
        got = [x for x in packing.fillings(packing._Left(counts, 30), 30) if x]
        assert {f for f, _ in got} == wanted and len(got) == len(wanted)
        assert [w for _, w in got] == sorted(30 - sum(f) for f in wanted)


def test_bin_completion_ends_with_the_fewest():
    import random

    def fewest(pieces, rooms):
        if not pieces:
            return len(rooms)
        best = fewest(pieces[1:], [*rooms, 40 - pieces[0]])
        for r in {x for x in rooms if x >= pieces[0]}:
            rest = list(rooms)
            rest.remove(r)
            best = min(best, fewest(pieces[1:], [*rest, r - pieces[0]]))
        return best

    rng = random.Random(5)
    for _ in range(30):
        pieces = sorted((rng.randrange(3, 30) for _ in range(8)), reverse=True)
        got = packing.bin_completion({s: pieces.count(s) for s in pieces}, 40)
        assert len(got) == fewest(pieces, []) and all(sum(b) <= 40 for b in got)


# --- rules


def brute_measure(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)} if len(w) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), inside


def test_measures_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120).collect()] + [t for _, t in ODD]
    for t in texts:
        n, chars, symbols, dups, inside = brute_measure(t)
        got = quality_rules.measure(t)
        assert got[:4] == (n, chars, symbols, dups)
        if inside is not None:
            assert got[4] == len(inside)


def test_rules_keep_clean_and_drop_junk(spark):
    got = registry.QUERIES["op8_quality_rules"](spark, SF_ORACLE).join(spark.read.parquet(f"{SF_ORACLE}/labels.parquet"), "doc_id")
    rows = got.where("not base_failed").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert all(clean) and sum(junk) <= 0.1 * len(junk)


def brute_edge(values, steps):
    """The end of the main body: from the median up to the first gap of three standard errors."""
    step, order = sum(steps) / len(steps) / 1000, sorted(values)
    at = (len(order) + 1) // 2 - 1
    while at + 1 < len(order) and order[at + 1] <= order[at] + 3 * ((order[at] + step) * step) ** 0.5:
        at += 1
    return order[at]


def test_limits_end_where_the_group_ends(spark):
    """Against plain sorting: a body, a tail that grows out of it, and a population beyond a gap."""
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source, step = ("a" if i % 3 else None), rng.randrange(5, 15)
        body = rng.randrange(0, 300) if source else rng.randrange(0, 60)
        rows.append((i, "en", source, rng.randrange(2500, 3500) if rng.random() < 0.4 else body, 1000 * step))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, symbols long, step_symbols long")
    for r in quality_rules.RULES:
        if r != "symbols":
            df = df.withColumn(r, F.lit(0).cast("long")).withColumn(f"step_{r}", F.lit(1).cast("long"))
    edge = {s: brute_edge([r[3] for r in rows if r[2] == s], [r[4] for r in rows if r[2] == s]) for s in ("a", None)}
    merged = brute_edge([r[3] for r in rows], [r[4] for r in rows])
    assert edge["a"] >= 290 and 50 <= edge[None] < 60
    for shrink in (0, 100):
        found = {r["_source"]: r["limits"]["symbols"] for r in quality_rules.limits(quality_rules.sketches(df), shrink).collect()}
        for s in edge:
            n = sum(r[2] == s for r in rows)
            assert found[s] == pytest.approx((n * edge[s] + shrink * merged) / (n + shrink), rel=0.03)


BAD = {
    "symbols": lambda w: [x + "#" if i % 4 == 0 else x for i, x in enumerate(w)],
    "word_length": lambda w: [x + "abcdef" for x in w],
    "capitals": lambda w: [x.upper() if i % 4 == 0 else x for i, x in enumerate(w)],
    "shouts": lambda w: [x + "!" if i % 4 == 0 else x for i, x in enumerate(w)],
    "repeats": lambda w: w[:240] + w[:70],
}


@pytest.mark.parametrize("rule", [*BAD, "dup_lines"])
def test_a_rule_adapts_to_its_source(documents, rule):
    """What is odd in source a is how source b writes: the same texts go from a and stay in b."""
    if rule == "dup_lines":
        plain = lambda i: "\n".join(words(200, i))
        bad = lambda i: "\n".join((w := words(200, i)) + w[80::-1])
    else:
        plain = lambda i: " ".join(words(300, i))
        bad = lambda i: " ".join(BAD[rule](words(300, i)))
    rows = [(i, plain(i)) for i in range(200)] + [(200 + i, bad(200 + i)) for i in range(20)]
    rows += [(300 + i, bad(200 + i)) for i in range(200)]
    df = documents(rows).withColumn("source", F.when(F.col("doc_id") < 300, "a").otherwise("b"))
    got = quality_rules.quality_rules(df, shrink=20).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(200, 220))


def test_small_groups_use_the_merged_sketch(documents):
    rows = [(i, " ".join(words(80, i))) for i in range(30)] + [(90, " ".join(w + "###" for w in words(80, 99)))]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(rows)).collect()}
    assert not got[90]["kept"] and all(got[i]["kept"] for i in range(30))


def test_a_hot_source_with_much_junk_drops_it(documents):
    """Two in five texts of a source that holds nearly all rows are junk."""
    clean = [(i, " ".join(words(80, i))) for i in range(360)]
    junk = [(1000 + i, " ".join(w + "#$%" for w in words(80, 1000 + i))) for i in range(240)]
    got = quality_rules.quality_rules(documents(clean + junk)).collect()
    assert len(got) == 600 and not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, _ in clean}


def test_rules_odd_rows(documents):
    got = quality_rules.quality_rules(documents(ODD, clashing=True).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert quality_rules.rules_digest(documents([])).count() == 0


# --- classifier


def test_classifier_on_held_out_rows(spark):
    got = registry.QUERIES["op10_quality_classifier"](spark, SF_ORACLE)
    assert got.count() == 1000
    rows = got.join(spark.read.parquet(f"{SF_ORACLE}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97


def test_held_out_rows_do_not_matter(spark):
    """Labels and texts of held-out rows changed: the same model."""
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held = quality_model.held_out_column(F.col("doc_id"))
    a = quality_model.fit(docs, labels)
    b = quality_model.fit(
        docs.withColumn("text", F.when(held, F.lit("###")).otherwise(F.col("text"))).withColumn("source", F.lit("x")),
        labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))),
    )
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior


def test_labels_on_all_rows_still_give_a_model(spark):
    """The unlabelled sample is all training texts, so none is needed without a label."""
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id")
    got = quality_model.quality_digest(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert {r["quality"] for r in got} == {0, 1}
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.97


@pytest.mark.parametrize("left", [0, 10])
def test_scarce_negative_labels_do_not_matter(spark, left):
    """All or nine of ten labels 0 removed: the same model, since no label 0 is read."""
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    few = labels.where((F.col("quality") == 1) | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 100 < left))
    rows = quality_model.quality_digest(docs, few).where("held_out").join(labels, "doc_id").collect()
    assert {r["quality"] for r in rows} == {0, 1}
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.97
    scores = [r["score"] for r in rows]
    assert 0 < min(scores) and max(scores) < 1 and len(set(scores)) > 0.9 * len(scores)


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.9):
        n = 20_000
        pos = np.column_stack([np.ones(3000), rng.normal(1.5, 0.6, (3000, 2))])
        k = int(prior * n)
        unl = np.column_stack([np.ones(n), np.concatenate([rng.normal(1.5, 0.6, (k, 2)), rng.normal(-1.5, 0.6, (n - k, 2))])])
        w = quality_model.density_ratio(pos.T @ pos / len(pos), unl.T @ unl / n)
        of_p, of_u = (np.bincount(quality_model.bins_of(x @ w), minlength=quality_model.BINS) for x in (pos, unl))
        got = quality_model.estimate_prior(of_p, of_u)
        assert got == pytest.approx(prior, abs=0.04)
        # brute force over all thresholds at the texts' own ratios: never below the least share by more than the error
        rp, ru = pos @ w, unl @ w
        best = min((ru >= c).mean() / (rp >= c).mean() for c in np.quantile(rp, np.linspace(0, 0.9, 50)))
        assert got >= best - 0.03


def test_risk_is_minimised_and_not_negative():
    rng = np.random.default_rng(0)
    d = 4
    pos = np.column_stack([np.ones(50), rng.normal(1, 1, (50, d - 1))])
    unl = np.column_stack([np.ones(400), np.concatenate([rng.normal(1, 1, (200, d - 1)), rng.normal(-1, 1, (200, d - 1))])])
    p, u = pos.T @ pos / len(pos), unl.T @ unl / len(unl)
    for prior in (0.3, 0.5, 0.9):
        def risk(w):
            part = ((1 + unl @ w) ** 2).mean() - prior * ((1 + pos @ w) ** 2).mean()
            return prior * ((1 - pos @ w) ** 2).mean() + max(0.0, part)

        w = quality_model.minimise_risk(p, u, prior)
        assert all(risk(w) <= risk(w + rng.normal(0, 0.3, d)) + 0.02 for _ in range(200))
    score = (unl @ quality_model.minimise_risk(p, u, 0.5)) > 0
    assert score[:200].mean() > 0.9 and score[200:].mean() < 0.2


def test_classifier_odd_rows(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0), (3, 0, 0)], none.schema)):
        got = quality_model.quality_digest(documents(ODD, clashing=True), labels).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        df = documents(ODD, clashing=True)
        kept = quality_model.keep_quality(df, labels, threshold=0.0)
        assert kept.columns == df.columns and kept.count() == len(ODD)
        assert quality_model.quality_digest(documents([]), labels).count() == 0
