import gzip
import math
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from kinfold.llm.chat_format import Formatter, Template, digest, format_chats
from kinfold.llm.decontaminate import find_leaks
from kinfold.llm.licenses import TEMPLATES, scan_licenses
from kinfold.llm.mixing import make_plan, mix, solve, with_copies
from kinfold.llm.quality_rules import COUNTS, cover, judge, keep_good, learn
from kinfold.llm.token_counts import count_tokens
from kinfold.llm.warc import LINES, NO_TEXT, RAW, build_derivatives, derive_records, pack, parse, plain_text, read, record, scan

from .helpers import corpus, frame, prose, targets, words

P = pytest.importorskip("public_tokenizers")


# --- token counts ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_librarys(spark, name):
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x3000), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(50)) for _ in range(60)]
    rows = corpus() + [(900 + i, t.replace("\x00", "")) for i, t in enumerate(odd)] + [(990, "a <|endoftext|> b"), (None, "no id")]
    path = P.path(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = count_tokens(frame(spark, rows), path, sample_share=0.5, limit=20).collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 20) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert count_tokens(frame(spark, []), path).collect() == []


# --- chat ------------------------------------------------------------------------------------

TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\[INST] \\\\</s> x\\"), (1, 2, "odd</s>", None), (1, 3, "assistant", ""), (2, None, None, "only"), (2, 5, "assistant", "<s>\\"), (2, 5, "assistant", "<s>\\"), (None, 0, "assistant", "é" * 9), (3, 0, "assistant", "very long </s> " * 20_000)]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("x", "c", "ids", "n_turns")})
    ranks = P.path("byte_bpe_50k.tiktoken")
    f = Formatter(ranks, P.PATTERN, Template())
    rows = {r.conv_id: r for r in format_chats(turns, ranks, P.PATTERN).collect()}
    for c in (1, 2, 3, None):
        mine = sorted((t for t in TURNS if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        import numpy as np

        ids, mask = np.array(rows[c].ids), np.array(rows[c].loss_mask)
        assert f.turns_of(ids) == [(r or "", t or "") for _, _, r, t in mine]
        assert "".join(f.learned_of(ids, mask)) == "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert rows[c].formatted.count("\n</s>") == len(mine)
    assert digest(format_chats(turns, ranks, P.PATTERN), ranks, P.PATTERN).count() == 4
    assert format_chats(turns.where("false"), ranks, P.PATTERN).collect() == []


# --- decontamination -------------------------------------------------------------------------


def _shingles(t, n=5):
    import re

    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set(), w


@pytest.mark.parametrize("bound", [64 << 20, 0], ids=["broadcast", "shuffled"])
def test_leaks_match_brute_force(spark, bound):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(6, 60))) for i in range(12)] + [(20, "two words"), (21, ""), (22, None), (23, "Only, one-thing here")]
    rows = corpus(5, 20)
    for i in range(0, 12):
        w = items[i][1].split()
        if i % 3 == 1:
            w[0] = "gone"
        if i % 3 == 2:
            w[len(w) // 2] = "gone"
        rows.append((100 + i, prose(rng, 80) + " " + " ".join(w).upper() + ", " + prose(rng, 30)))
    rows += [(300, (prose(rng, 20_000) + " " + items[1][1] + " ") * 2)]  # very long
    rows += [(200, "x two  WORDS y only one thing here"), (None, items[0][1]), (201, items[4][1]), (201, items[4][1])]
    want = set()
    for d, t in rows:
        for i, x in items:
            s, w = _shingles(x)
            n = min(5, len(w))
            v = _shingles(t)[1]
            have = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if s and len(s & have) >= 0.8 * len(s):
                want.add((d, i, len(s), len(s & have)))
    leaks = find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=bound)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_matched) for r in leaks.collect()} == want and len(want) > 8
    assert find_leaks(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).collect() == []


# --- licenses --------------------------------------------------------------------------------


def test_license_matches(spark):
    rng = random.Random(4)
    mit = TEMPLATES["MIT"].split(" ")
    cut = " ".join(mit[:20] + ["really"] + mit[22:])
    rows = [(1, prose(rng, 50) + "\n" + TEMPLATES["GPL-3.0-statement"] + "\n" + prose(rng, 20)), (2, cut), (3, prose(rng, 200)), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0. " * 2), (7, TEMPLATES["Apache-2.0"].lower()), (8, " ".join(mit[:40]))]
    got = {}
    for r in scan_licenses(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2), r.begin, r.end))
    assert got[1] == [("GPL-3.0-statement", 1.0, 50, 62)]
    assert [x[0] for x in got[2]] == ["MIT"] and got[2][0][1] > 0.95
    assert [x[0] for x in got[6]] == ["CC-BY-NC-4.0-statement"] * 2 and [x[2] for x in got[6]] == [0, 7]
    assert [x[0] for x in got[7]] == ["Apache-2.0"]
    assert set(got) == {1, 2, 6, 7}
    with pytest.raises(ValueError):
        scan_licenses(frame(spark, rows), index_bytes=10)
    assert scan_licenses(frame(spark, [])).collect() == []


def _brute_licenses(doc, templates, band, threshold, low=0, high=None):
    """Best match of any template on any diagonal between low and high; then the same on both sides of it."""
    high = len(doc) if high is None else high
    best = None
    for name, t in sorted(templates.items()):
        for s in range(low - len(t), high):
            # (matched, -begin, -end) of the template's first i words against words before p, by place p
            rows = {}
            for i in range(len(t) + 1):
                for p in range(i + s - band - 1, i + s + band + 1):
                    options = [(0, 0, 0)]
                    if i and (i - 1, p) in rows:
                        options.append(rows[i - 1, p])
                    if (i, p - 1) in rows:
                        options.append(rows[i, p - 1])
                    if i and low < p <= high and -band <= p - i - s <= band and (i - 1, p - 1) in rows and doc[p - 1] == t[i - 1]:
                        k, b, _ = rows[i - 1, p - 1]
                        options.append((k + 1, b if k else -(p - 1), -p))
                    rows[i, p] = max(options)
            k, b, e = max(rows.values())
            if k and k >= threshold * len(t):
                x = (-k, -k / len(t), name, -b, -e)
                best = min(best or x, x)
    if best is None:
        return []
    mine = (best[2], -best[0], best[3], best[4])
    return _brute_licenses(doc, templates, band, threshold, low, best[3]) + [mine] + _brute_licenses(doc, templates, band, threshold, best[4], high)


def test_license_scan_matches_an_alignment_on_every_diagonal(spark):
    rng = random.Random(14)
    many = [f"q{i}" for i in range(18)]
    known = {"seven": "licensed under by nc four point oh", "six": "released as all my license text", "many": " ".join(many), "more": " ".join([*many[:15], "other", "end"])}
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = known[rng.choice(sorted(known))].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], ["new"], [rng.choice(w)]])
            parts += w[rng.randrange(3) :] + prose(rng, rng.randrange(4), 20).split()
        rows.append((i, " ".join(parts)))
    want = [(i, *x) for i, t in rows for x in sorted(_brute_licenses(t.split(), {k: v.split() for k, v in known.items()}, 2, 0.8), key=lambda x: x[2])]
    got = [(r.doc_id, r.license, r.n_matched, r.begin, r.end) for r in scan_licenses(frame(spark, rows), known, band=2).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_neighbouring_and_shortened_licenses_in_long_texts(spark):
    rng = random.Random(15)
    gpl = TEMPLATES["GPL-3.0"]
    short = " ".join(gpl.split()[2:])
    rows = [(1, gpl + " " + short), (2, gpl + " one two three four " + short), (3, prose(rng, 30_000) + " " + TEMPLATES["BSD-2-Clause"] + " " + prose(rng, 30_000)), (4, TEMPLATES["GPL-2.0-statement"]), (5, TEMPLATES["BSD-3-Clause"] * 300)]
    got = {}
    for r in scan_licenses(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.n_matched, r.begin))
    assert got[1] == [("GPL-3.0", 104, 0), ("GPL-3.0", 102, 104)] and got[2] == [("GPL-3.0", 104, 0), ("GPL-3.0", 102, 108)]
    assert got[3] == [("BSD-2-Clause", 186, 30_000)] and got[4] == [("GPL-2.0-statement", 12, 0)]
    assert len(got[5]) == 300


# --- quality rules ---------------------------------------------------------------------------


def _counts(t):
    import re
    from collections import Counter

    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    again = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_statistics_match_brute_force(spark):
    rows = corpus(7, 20) + [(500, "a b c a b c a b c\n\n a b \n a b \n#|x"), (501, "p q r s p q r"), (None, "z")]
    got = judge(frame(spark, rows), []).collect()
    want = [(i, *_counts(t), _counts(t)[0] < 50 or 100 * _counts(t)[4] > 50 * _counts(t)[0]) for i, t in rows]
    assert sorted([(r.doc_id, *[r[c] for c in COUNTS[:5]], r.base_failed) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.kept != r.base_failed for r in got)
    assert judge(frame(spark, []), []).collect() == []


def test_rules_are_learned_and_hold_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, rng.randrange(60, 150), 2000)
        if i % 4 == 0:
            t = " ".join(w + rng.choice(["###", "$$$", ""]) for w in t.split())
        elif i % 4 == 1:
            t = " ".join(rng.choices(t.split()[:8], k=100))
        rows.append((i, t))
        labels.append((i, int(i % 4 > 1)))
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels[:250] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    rules = learn(docs, known)
    assert 1 <= len(rules) <= 4
    kept = {r.doc_id: r.kept or r.base_failed and r.doc_id % 4 > 1 for r in judge(docs, rules).collect()}
    right = sum(kept[i] == bool(q) for i, q in labels[250:])
    assert right >= 0.95 * 150
    good = keep_good(docs, rules)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in judge(docs, rules).where("kept").collect()}
    assert learn(docs, known.where("false")) == [] and learn(docs.where("false"), known) == []
    for r in judge(docs, rules).collect():  # the list, read by hand on counts made by hand
        n, chars, symbols, dup, again = _counts(rows[r.doc_id][1])
        w, lines = words(rows[r.doc_id][1]), [x for x in rows[r.doc_id][1].split("\n") if words(x)]
        x = {"words": n, "word_length": chars / n, "symbol_share": symbols / n, "dup_line_share": dup / len(lines), "repeat_share": again / n, "vocabulary_growth": math.log(len(set(w))) / math.log(n)}
        bad = any(all((x[t.feature] > t.cut) == t.above for t in rule) for rule in rules)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed and not bad)


def test_cover_prunes_noise():
    table = [(h, 10, 0, (3,)) for h in (False, True)] + [(h, 1, 30, (0,)) for h in (False, True)]
    assert cover(table, ["f"], {"f": 3}, 5, 3, 0.75) == [[("f", True, 0)]]


# --- mixing ----------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["b", "b", "b", "b", "é", None, "a"]), 0) for i in range(3000)] + [(5000 + i, "w " * 4, "en", "tiny", 0) for i in range(5)] + [(6000, None, "en", "zero", None), (6001, "", "en", "a", 0), (1, "w w", "en", "a", 0), (1, "w w", "en", "a", 0), (None, "w", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("d", "s", "size", "k", "bin", "rate")})
    wanted, total = targets([(r[3], len(words(r[1]))) for r in rows])
    got = mix(df).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - wanted[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t) or s == "tiny", (s, taken[s], t)
        # the entropy-balanced rates: exponentially tilted by size with one multiplier, and meeting the target
        mine = [r for r in got if r.source == s and r["size"] > 0]
        tilts = [math.log(r.rate) / r["size"] for r in mine if 0 < r.rate < 3]
        assert not tilts or max(tilts) - min(tilts) < 1e-9 * max(1, abs(tilts[0]))
        assert abs(sum(r.rate * r["size"] for r in mine) - t) <= 1e-5 * max(1, t)
    key = lambda rs: sorted([(r.doc_id, r.source, r.taken) for r in rs], key=repr)
    assert key(mix(df.repartition(7)).collect()) == key(got)
    salted = with_copies(df, make_plan(df, broadcast_bytes=0), broadcast_bytes=0)
    assert key(salted.select("row.doc_id", "row.source", "taken").collect()) == key(got)
    assert mix(df.where("false")).collect() == []
    assert {r.taken for r in mix(df.where("source = 'zero'")).collect()} == {0}


def test_solver_raises_if_it_does_not_settle(spark):
    histogram = spark.createDataFrame([(1, 10, 5), (1, 20, 5)], "k long, size long, n long")
    goals = spark.createDataFrame([(1, 15.0, 100.0)], "k long, mean double, target double")
    assert solve(histogram, goals, 3).count() == 1
    with pytest.raises(RuntimeError):
        solve(histogram, goals, 3, rounds=1)
    huge = spark.createDataFrame([(1, 1, 10), (1, 1_000_000, 1)], "k long, size long, n long")  # a giant among single words
    (x,) = solve(huge, spark.createDataFrame([(1, 1_000_010 / 11, 5.0)], "k long, mean double, target double"), 3).collect()
    assert abs(10 * math.exp(x.multiplier * 11 / 1_000_010) - 5) < 1e-3


# --- WARC ------------------------------------------------------------------------------------

PAGE = '<html><head><title>T &amp; x</title><style>p{}</style></head><body><p>a <b>b</b>&eacute;</p><script>no()</script><!-- no --><a href="/u?a=1&amp;b=2">l</a><br>end < 3</body></html>'


def test_warc_derivatives(spark, tmp_path):
    assert plain_text(PAGE) == "T & x\na bé\nl\nend < 3"
    pages = spark.createDataFrame([(1, "http://x.org/1", PAGE), (2, None, None), (3, "http://x.org/3", ""), (1, "http://x.org/1", PAGE)], "page_id long, url string, html string").withColumn("record", F.lit(1))
    out = build_derivatives(pages)
    rows = out.collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    for r in rows:
        ((fields, block),) = parse(bytes(r.record))
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Type"] == r.record_type and fields["WARC-Record-ID"] == r.record_id
        assert fields.get("WARC-Target-URI") == r.target_uri
        if r.page_id == 1 and r.record_type == "metadata":
            assert b"outlink: /u?a=1&b=2" in block and f"source-payload-digest: {r.source_digest}".encode() in block and b"source-header-content-type: text/html" in block
        if r.page_id == 1 and r.record_type == "conversion":
            assert block.decode() == plain_text(PAGE)
    folder = tmp_path / "warc"
    folder.mkdir()
    for f in pack(out, per_file=3).collect():
        (folder / f.name).write_bytes(f.content)
    back = read(spark, str(folder)).collect()
    assert sorted(r.record_id for r in back) == sorted(r.record_id for r in rows)
    assert build_derivatives(pages.where("false")).collect() == []


class _Reader(HTMLParser):
    """Text and links of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.skip = [], {}, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links |= {v.strip(): None for k, v in attrs[:] if k == "href" and v and v.strip()}
        if tag in RAW | NO_TEXT:
            self.parts += [] if self.skip else [" "]
            self.skip.append(tag)
        elif tag in LINES and not self.skip:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in NO_TEXT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif tag in LINES and not self.skip:
            self.parts.append("\n")

    def handle_data(self, data):
        self.parts += [] if self.skip else [data]


def _read(page):
    p = _Reader()
    p.feed(page)
    p.close()
    lines = (" ".join(x.replace("\xa0", " ").split(" ")).split() for x in "".join(p.parts).split("\n"))
    return "\n".join(" ".join(x) for x in lines if x), list(p.links)


def test_scan_agrees_with_another_parser():
    rng = random.Random(16)
    for _ in range(300):
        parts = ["<html><body class='x y'>"]
        for _ in range(rng.randrange(1, 25)):
            word = rng.choice(["a b", "&lt;p&gt; &amp; &eacute;&#233;", "  spaced   out ", "1 < 2", "line\nbreak", "ü", "\t"])
            parts.append(rng.choice([f"<p>{word}</p>", f"<b>{word}</b>", f"<div id=\"1>2\">{word}</div>", "<br/>", "<!-- <p>no</p> -->", "<script>if (a<b) '<p>'</script>", f"<a title='>' href=\"/{rng.randrange(5)}?a&amp;b\">{word}</a>", "<A HREF=/q>x</A>", f"<svg><g>{word}</g></svg>", "<svg/>", "<template><p>t</p></template>", "<noscript><a href='/n'>n</a></noscript>", "<style>p > b {}</style>", word, "<a name=z>", f"<li>{word}<ul><li>{word}</ul>"]))
        page = "".join(parts) + "</body></html>"
        assert scan(page) == _read(page), page


def test_hostile_pages_take_linear_time_and_lose_nothing_else(spark):
    pieces = ["<a ", "<b", " ", "<!-- ", "<iframe>", '<a ">" ', "<a '", "<svg>", "</svg>", "<a href", "&#9", "&#0", "&", "<a href='x' ", "<template>"]
    pages = [("start " + x * (5_000_000 // len(x))) for x in pieces]
    begun = time.time()
    for page in pages:
        assert scan(page)[0].startswith("start")
    assert time.time() - begun < 60
    assert plain_text("a <svg viewbox=1/> b <object data=x>c") == "a b c" and plain_text("a<script>b") == "a" and plain_text("x &#99999999999999999999; y") == "x \ufffd y"
    assert scan('a <p class="x>b</p><a href=/y>c</a>') == ("a\nb\nc", ["/y"])
    out = build_derivatives(spark.createDataFrame([(1, "u", pages[0]), (2, None, "ok")], "page_id long, url string, html string")).collect()
    assert len(out) == 4


def test_real_responses(spark, tmp_path):
    def http(head, body):
        return head.encode() + b"\r\n\r\n" + body

    page = "<p>grüße</p><a href='/x'>y</a>".encode("latin-1")
    chunked = b"5;x=1\r\n" + page[:5] + b"\r\n%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    blocks = [
        http("HTTP/1.1 203 Odd\r\nServer:nginx\r\nContent-Type: text/html; charset=iso-8859-1", page),
        http("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nTransfer-Encoding: chunked", chunked),
        http("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip", gzip.compress(page)),
        http("HTTP/1.1 200 OK\r\nContent-Type: image/png", b"\x89PNG"),
        http("HTTP/1.1 200 OK\r\nContent-Type: text/plain", b"a <b> c"),
    ]
    data = [record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n")]
    data += [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("WARC-Target-URI", f"http://h/{i}"), ("WARC-Date", "2020-01-02T03:04:05Z")], b) for i, b in enumerate(blocks)]
    loose = b"\r\nWARC/1.0\nwarc-type:response\nWARC-Record-ID: <9>\nX-Folded: a\n b\ncontent-length:%d\n\n" % len(blocks[0]) + blocks[0] + b"\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))
    (tmp_path / "b.warc").write_bytes(b"".join(data[:2]) + loose)
    back = read(spark, str(tmp_path))
    assert back.count() == len(data) + 3 and {r.fields.get("X-Folded") for r in back.collect()} == {None, "a b"}
    got = {(r.refers_to, r.record_type): next(parse(bytes(r.record))) for r in derive_records(back).collect()}
    assert {k for k in got if k[1] == "conversion"} == {(f"<{i}>", "conversion") for i in (0, 1, 2, 4, 9)}
    for i in (0, 1, 2, 9):
        assert got[f"<{i}>", "conversion"][1].decode() == "grüße\ny" and b"outlink: /x" in got[f"<{i}>", "metadata"][1]
    assert got["<4>", "conversion"][1] == b"a <b> c"
    fields, about = got["<0>", "metadata"]
    assert fields["WARC-Date"] == "2020-01-02T03:04:05Z" and fields["WARC-Target-URI"] == "http://h/0"
    assert b"source-status: HTTP/1.1 203 Odd" in about and b"source-header-server: nginx" in about
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"))
