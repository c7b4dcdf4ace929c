"""Each operator against a brute-force version or an exact answer, and its edge cases."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import bpe, fingerprint, html_text, line_dedup, mixing, near_dup, substring_dedup, toxicity, url_filter, vector_search
from tallyloom.llm.queries import URL_RULES
from tallyloom.llm.url_filter import Rule
from tallyloom.llm.words import shingle_set, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (None, "one"), (5, "é" * 5000 + " x\n" * 300)]


# url filters


def test_urls_by_hand(spark):
    rules = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("block", "net"), Rule("block", "ads.org/*/banner")]
    urls = {
        "http://A.Example.COM/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://example.com/en/8#t": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://example.com/EN/7": ("example.com", "/EN/7", None, "allow"),
        "x://a.net?q": ("a.net", "", "net", "block"),
        "http://anet/": ("anet", "/", None, "allow"),
        "http://x.ads.org/1/2/banner9": ("x.ads.org", "/1/2/banner9", "ads.org/*/banner", "block"),
        "http://com:80/en/7": ("com:80", "/en/7", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == urls
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_rules_of_the_query_are_those_of_its_contract(spark):
    urls = {
        "http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"),
        "http://x.com/en/7": ("com/en/", "block"), "http://w.example.com/en/7": ("example.com/en/7", "allow"), "http://x.org/es/": ("org/es/", "block"), "http://x.org/fr/": (None, "allow"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: (r.rule, r.verdict) for r in url_filter.filter_urls(df, URL_RULES).collect()} == urls


def test_rules_stand_under_their_rarest_token():
    index = url_filter.rule_index([Rule("block", "com/en/"), Rule("block", "com/de/"), Rule("block", "*")])
    assert {k: [r.pattern for r in v] for k, v in index.items()} == {"en": ["com/en/"], "de": ["com/de/"], "": ["*"]}


# line dedup


def brute_lines(rows, n=2, long=20):
    """Marks every window of n non-blank lines, and every line of so many words, that stands earlier."""
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        filled = [(k, " ".join(x.lower().split())) for k, x in enumerate(lines) if x.strip()]
        gone, size = set(), min(n, len(filled))
        windows = [filled[a : a + size] for a in range(len(filled) - size + 1)] if filled else []
        if size > 1:
            windows += [[x] for x in filled if len(x[1].split()) >= long]
        for w in windows:
            key = tuple(x for _, x in w)
            if key in seen:
                gone |= {k for k, _ in w}
            seen.add(key)
        left = [x for k, x in enumerate(lines) if k not in gone]
        out[i] = ("\n".join(left) if any(x.strip() for x in left) else "") if gone else text
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = [words(rng, 3) for _ in range(12)] + ["", "  ", "A  b", "a b "] + [words(rng, n) for n in (19, 20, 60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_lines(rows)


def test_lines_edge_cases(spark):
    got = line_dedup.dedup_lines(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert Counter((r.doc_id, r.text) for r in got)[(None, "one")] == 1  # null ids come first
    assert [r.text for r in got if r.doc_id == 4] == ["", ""]  # rows equal in id and text count as one
    assert line_dedup.dedup_lines(docs(spark, EDGE).limit(0)).count() == 0
    extra = docs(spark, [(1, "a\nb"), (2, "a\nb")]).withColumnsRenamed({"lang": "gone", "source": "of", "n_chars": "__id"})
    assert sorted((r.text, r.of) for r in line_dedup.dedup_lines(extra).collect()) == [("", "s"), ("a\nb", "s")]


def test_long_lines_go_alone_and_very_long_texts_take_seconds(spark):
    rng = random.Random(24)
    passage, short = words(rng, 51), words(rng, 8)
    rows = [(i, f"{words(rng, 5)}\n{passage}\n{words(rng, 5)}\n{short}\n{words(rng, 5)}") for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: t if not i else t.replace(passage + "\n", "") for i, t in rows}
    many = "\n".join(f"line {k % 50_000}" for k in range(100_000))
    start = time.monotonic()
    assert [len(r.gone) for r in line_dedup.dedup_lines(docs(spark, [(1, many)])).collect()] == [50_000]
    assert time.monotonic() - start < 60


# html extraction


PAGE = """<html><body class="home"><header>Site</header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div>
<div class="post-12"><h1>Title &amp; more</h1><p>First <b>bold</b><br>line&nbsp;here <script>x</script><p>Second {n}<form>Mail <input></form></div>
<div class="comments"><p>nice post, very long comment, longer than the article itself, on and on and on</p></div>
<div class="x{n}">unmarked text at the foot</div><footer>f</footer></body></html>"""


def test_html_by_hand(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(n=i)) for i in range(1, 5)] + [(9, None, None), (10, "http://h.org/", ""), (11, "http://x.org/", "<div class=ad>buy</div>"), (12, None, "plain &lt;text")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(1, 5):
        text = f"Title & more\nFirst bold line here\nSecond {i}"
        assert got[i] == (text, len(text))
    assert got[9] == got[10] == got[11] == ("", 0)
    assert got[12] == ("plain <text", 11)
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_votes_decide_where_a_page_is_odd(spark):
    long, short = "<p>" + "word " * 80 + "</p>", "<p>tiny</p>"
    page = "<body><div class='story'>{a}</div><div class='extra'>{b}</div></body>"
    rows = [(i, "http://h.org/", page.format(a=long, b=short)) for i in range(9)] + [(9, "http://h.org/", page.format(a=short, b=long))]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "tiny"


def test_html_keeps_the_whole_article_around_the_largest_part(spark):
    lead, rest = "lead " * 30, "rest " * 70
    bodies = [
        f"<article><p>{lead}</p><section>{rest}</section></article>",
        f"<article><p>{lead}</p><blockquote>{rest}</blockquote></article>",
        f"<main><p>{lead}</p><table><tr><td>{rest}</td></tr></table></main>",
        f"<article><section class=a>{lead}</section><section class=b>{rest}</section></article>",
        f"<div class=post><p>{lead}</p><div class=story>{rest}</div></div>",
    ]
    rows = [(i, f"http://h{i}.org/", f"<body><nav>menu</nav>{b}<div class=ad>buy</div></body>") for i, b in enumerate(bodies)]
    # most pages of a host vote for the inner path
    rows += [(10 + i, "http://i.org/", f"<body><div class=post><div class=story>{rest}</div></div></body>") for i in range(9)] + [(19, "http://i.org/", rows[4][2])]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = f"{lead.strip()}\n{rest.strip()}"
    assert got == {i: rest.strip() if 10 <= i < 19 else both for i, _, _ in rows}


def test_html_containers_that_hold_the_text_stay():
    """Names of the layout on the outermost container, and of matters inside an article, drop nothing."""
    article = "<h1>Title</h1><p>" + "A long and telling line of text. " * 8 + "</p><p>And its end.</p>"
    want = "Title\n" + ("A long and telling line of text. " * 8).strip() + "\nAnd its end."
    for names in ('class="page no-sidebar"', 'class="has-sidebar with-menu"', 'class="form-page"', 'id="searchform-results"', 'class="site menu-closed"', 'class="widget-area wide"', 'class="post tags-none"'):
        page = html_text.Page(f"<html><body><nav><a href=x>Home</a></nav><div {names}><div class='post'>{article}</div></div><div class='sidebar-left'>Aside</div><footer>Foot</footer></body></html>")
        assert page.text(page.best()) == want, names
    legal = html_text.Page(f"<body><article>{article}<p class='legal'>By law.</p><p class='ad'>Buy!</p><div class='notice'>We use cookies.</div></article><div id='comments'>" + "<p>I say so too, and more than the article.</p>" * 9 + "</div></body>")
    assert legal.text(legal.best()) == want + "\nBy law."
    talk = html_text.Page("<body><div class='discussion'>" + article + "</div></body>")
    assert talk.text(talk.best()) == want


def test_html_inline_parts_go():
    text = lambda body: html_text.Page(f"<body><article>{body}</article></body>").extract([])
    assert text("<p>Hello <button>Share</button> world</p>") == "Hello world"
    assert text("<p>Text</p><span class='advert'>Buy now</span><p>more</p>") == "Text\nmore"
    assert text("a <span hidden>secret</span>b <a class='share-link'>Tweet</a> <select><option>x</select> c <svg><text>y</text></svg>") == "a b c"
    assert text('<p title="foo>Hello') == "Hello"
    assert text("<p>1 < 2 and </> 3 <b>bold</b>er &amp; &lt;b>") == "1 < 2 and </> 3 bolder & <b>"
    assert text("<p>one<p>two<ul><li>a<li>b</ul></div>three</b>") == "one\ntwo\na\nb\nthree"


def test_html_of_very_long_pages_is_read_once():
    start = time.monotonic()
    assert "<a" in html_text.Page("<a " * 16_000).extract([])
    html_text.Page("<a \"" * 16_001 + ">").extract([])
    html_text.Page("</script" * 16_000 + "<script>" * 16_000).extract([])
    assert html_text.Page("<div>" * 8_000 + "deep").extract([]) == "deep"
    assert html_text.Page("<b><div>" + "<i>" * 8_000 + "</b>" * 8_000 + "text").extract([]) == "text"
    assert html_text.Page("<p>" * 20_000 + "x").extract([]) == "x"
    assert time.monotonic() - start < 5


def test_html_against_a_tree(spark):
    """Pages made from a tree of known parts, whose article is put together from the tree itself."""
    rng = random.Random(19)
    rows, want = [], {}
    for i in range(60):
        blocks, body = [], []
        for _ in range(rng.randint(3, 8)):
            t = words(rng, rng.randint(5, 40))
            kind = rng.choice(["p", "h2", "li", "blockquote", "bold", "noise", "script"])
            if kind == "noise":
                body.append(rng.choice(["<aside>{}</aside>", "<div class='ad-box'>{}</div>", "<form>{}</form>", "<!-- {} -->"]).format(t))
                continue
            if kind == "script":
                body.append(f"<script>if (a < b) {{ '{t}' }}</script>")
                continue
            blocks.append(t.replace("a", "&") if kind == "p" else t)
            body.append({"bold": f"<p>{t.replace(' ', ' <b>', 1)}</b></p>", "p": f"<p>{t.replace('a', '&amp;')}</p>"}.get(kind, f"<{kind}>{t}</{kind}>"))
        rows.append((i, f"http://h{i % 5}.org/{i}", f"<html><body><nav>{words(rng, 20)}</nav><main class='m{i}'>{''.join(body)}</main><footer>{words(rng, 9)}</footer></body></html>"))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_rare_paths_fall_back_to_the_page_itself(spark):
    body = "word " * 60
    rows = [(i, "http://h.org/", f"<div class=a><p>{body}</div>") for i in range(40)] + [(99, "http://h.org/", f"<div class=b><p>{body}odd</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = html_text.winning_paths(html_text.votes(pages)).collect()
    assert [(r.host, r.paths) for r in paths] == [("h.org", ["div.a"])]
    assert html_text.winning_paths(html_text.votes(pages.limit(0))).count() == 0
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got[99] == f"{body}odd" and got[0] == body.strip()


def test_html_rows_carry_their_url(spark):
    rows = [(1, "http://h.org/1", "<p>a"), (2, None, "<p>b"), (3, "http://h.org/3", None)]
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.url for r in out.collect()} == {i: u for i, u, _ in rows}


# fingerprints


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([1, 3, 20, 60, 400]))) for i in range(40)] + [(100, None), (101, ""), (102, "x"), (103, words(rng, 60_000))]
    got = {r.doc_id: r for r in fingerprint.compare_edited(docs(spark, rows).repartition(5)).collect()}
    order = sorted(rows)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[k - 1][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[i].fingerprint == fingerprint.to_string(fingerprint.fingerprints([text.encode()])[0])  # whatever else is in the batch
        assert got[i].edited_fingerprint == fingerprint.to_string(fingerprint.fingerprints([edited.encode()])[0])
        if len(text) > 300:
            assert got[i].near_edited > 0.3 > got[i].near_next
    assert got[100].fingerprint == got[101].fingerprint == ""
    assert fingerprint.compare_edited(docs(spark, []).limit(0)).count() == 0
    one = fingerprint.compare_edited(docs(spark, [(7, "hello world, this is it")])).collect()
    assert [r.near_next for r in one] == [1.0]
    assert fingerprint.compare_edited(docs(spark, EDGE)).count() == len(EDGE)


def test_entropy_levels_against_the_definition():
    buf = np.frombuffer(words(random.Random(3), 200).encode() + bytes(100), dtype=np.uint8)
    for i, level in enumerate(fingerprint.levels(buf)):
        p = np.bincount(buf[i : i + fingerprint.WINDOW]) / fingerprint.WINDOW
        p = p[p > 0]
        assert abs(-(p * np.log2(p)).sum() / np.log2(fingerprint.WINDOW) * (fingerprint.LEVELS - 1) - level) <= 1


def brute_features(raw):
    """The chosen windows of a text by the definition, in order of place."""
    f = fingerprint
    n = max(len(raw) - f.WINDOW + 1, 1) if raw else 0
    windows = [raw[i : i + f.WINDOW].ljust(f.WINDOW, b"\0") for i in range(n)]

    def rank(w):
        p = [c / f.WINDOW for c in Counter(w).values()]
        level = int(-sum(x * np.log2(x) for x in p) / np.log2(f.WINDOW) * (f.LEVELS - 1) + 0.5)
        return 2 * f.LEVELS if level < f.LEAST_LEVEL else f.LEVELS - abs(level - f.COMMON_LEVEL)

    ranks = [rank(w) for w in windows]
    width = min(max(n // f.SHARE, 1), f.NEIGHBOURS)
    times = Counter()
    for a in range(1 - width, n):
        near = [(ranks[i], i) for i in range(max(a, 0), min(a + width, n)) if ranks[i] < 2 * f.LEVELS]
        if near:
            times[min(near)[1]] += 1
    chosen = sorted(i for i, c in times.items() if c >= max(1, width // f.FIRST_IN))
    return [windows[i] for i in (chosen or ([min(range(n), key=lambda i: (ranks[i], i))] if n else []))]


def test_chosen_windows_chain_and_likeness_against_the_definition():
    rng = random.Random(22)
    texts = [b"", b"a", b"ab" * 4, b"a" * 300, bytes(40) + b"x" * 3, "é日".encode() * 90] + [words(rng, n).encode() for n in (1, 2, 3, 5, 9, 20, 45, 90, 200, 900)]
    chains = fingerprint.fingerprints(texts)
    sets = []
    for t, c in zip(texts, chains, strict=True):
        chosen = list(dict.fromkeys(brute_features(t)))
        groups = [chosen[i : i + fingerprint.PER_FILTER] for i in range(0, len(chosen), fingerprint.PER_FILTER)]
        assert len(c) == len(groups), t
        own = [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in c]
        # the same windows, wherever they stand, set the same bits, and no others
        for bits, group in zip(own, groups, strict=True):
            made = set()
            for w in group:
                one = np.unpackbits(fingerprint.fingerprints([w.rstrip(b"\0") or w])[0][0])
                made |= set(np.flatnonzero(one).tolist())
            assert bits == made
        sets.append(own)
    most = fingerprint.FILTER_BYTES * 8
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            few, many = sorted((x, y), key=len)
            if not few or not many:
                want = float(len(x) == len(y))
            else:
                best = [max(min(max((len(p & q) - len(p) * len(q) / most) / (max(len(p), len(q)) - len(p) * len(q) / most), 0), 1) for q in many) for p in few]
                want = sum(v * len(p) for v, p in zip(best, few, strict=True)) / sum(map(len, few))
            if len(x) != len(y) or texts[a] == texts[b] or not x:
                assert abs(fingerprint.likeness(chains[a], chains[b]) - want) < 1e-5


def test_edits_of_another_length_are_as_near():
    """Whatever the text's length, one edit of the same and one of a smaller length."""
    rng = random.Random(26)
    for n in (270, 530, 540, 700, 1030, 1045, 1100, 1600, 2100):
        near = []
        for _ in range(6):
            text, other = words(rng, 600)[:n], words(rng, 600)
            edits = [text[: n - n // 3] + other[:size] for size in (n // 3, max(n // 3 - n // 20, 1))]
            chains = fingerprint.fingerprints([x.encode() for x in (text, *edits)])
            near.append([fingerprint.likeness(chains[0], c) for c in chains[1:]])
        assert np.mean(near, axis=0).min() > 0.4, (n, near)


def test_short_edits_are_near():
    rng = random.Random(23)
    for n in (60, 150, 258, 300, 380, 600):
        text = words(rng, 200)[:n]
        edited = text[: n - n // 3] + "x"
        a, b = fingerprint.fingerprints([text.encode(), edited.encode()])
        assert fingerprint.likeness(a, b) > 0.25, n


# substring dedup


def brute_units(rows):
    """Marked unit numbers by a plain scan over all units in order."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        u = substring_dedup.Units([text.encode()])
        out[i] = [k for k in range(len(u.hash)) if u.words[k] >= substring_dedup.UNIT_WORDS and seen.setdefault(int(u.hash[k]), (i, k)) != (i, k)]
    return out


def test_substrings_against_brute_force_and_planted(spark):
    rng = random.Random(4)
    sentence = lambda: words(rng, rng.randint(3, 25)).capitalize() + ". "
    clean = [(i, "".join(sentence() + ("\n" if rng.random() < 0.3 else "") for _ in range(12))) for i in range(30)]
    prose, plain = "".join(sentence() for _ in range(8)), words(rng, 70)
    planted = [(100 + i, words(rng, 9) + " " + (prose if i % 2 else plain) + " " + words(rng, 9)) for i in range(8)]
    planted.append((200, "é " + words(rng, 5) + "\n" + plain + "\n" + words(rng, 5)))
    rows = clean + planted
    marks = {r.doc_id: sorted(m >> 32 for m in r.marks) for r in substring_dedup.marked_units(docs(spark, rows).repartition(4)).collect()}
    assert marks == {i: m for i, m in brute_units(rows).items() if m}
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs(spark, rows)).collect()}
    original = dict(rows)
    for i, text in clean:
        assert got[i].text == text and got[i].removed == []
    for i, text in planted:
        assert (got[i].text == text) == (i in (100, 101)), i
        kept, at = [], 0
        for s in got[i].removed:
            kept.append(original[i][at : s.start])
            at = s.end
        assert got[i].text == "".join(kept) + original[i][at:]
        if i not in (100, 101):
            assert len(got[i].text.split()) < len(text.split()) - 30


def test_every_passage_of_over_50_words_goes_wherever_it_stands(spark):
    rng = random.Random(13)
    few = words(rng, 6).split()

    def text(kind, n):
        if kind == "few":  # the same words again and again
            return [rng.choice(few) for _ in range(n)]
        out = words(rng, n).split()
        stop = {"plain": 0, "prose": 0.08, "lines": 0.15}[kind]
        return [w + ("." if rng.random() < stop else "") for w in out]

    rows, inside = [], {}
    for k in range(240):
        kind, n = ("plain", "prose", "lines", "few")[k % 4], 51 if k % 3 else 60
        passage = text(kind, n)
        for i in (k, 1000 + k):
            before, after = (text(kind, rng.randint(0, 90)) for _ in range(2))
            between = rng.choice([" ", "\n"]) if kind == "lines" else " "
            rows.append((i, between.join(before + passage + after)))
            inside[i] = (len(before), n)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs(spark, rows).repartition(4)).collect()}
    original, most = dict(rows), 10
    for i in range(1000, 1240):
        at, n = inside[i]
        flags = []
        for s in got[i].removed:
            lo = len(original[i][: s.start].split())
            flags += range(lo, lo + len(original[i][s.start : s.end].split()))
        assert len(set(flags) & set(range(at, at + n))) >= n - most, i


def test_substrings_edge_cases(spark):
    got = substring_dedup.dedup_substrings(docs(spark, EDGE)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t in EDGE if i != 5) + Counter([(5, r.text) for r in got if r.doc_id == 5])
    assert substring_dedup.dedup_substrings(docs(spark, EDGE).limit(0)).count() == 0


# near duplicates


def brute_components(rows, n, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rng = random.Random(5)
    rows, i = [], 0
    for size in (1, 2, 4, 10, 40, 40, 200):
        base = words(rng, size).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 12))):
                w[rng.randrange(size)] = words(rng, 1)
            rows.append((i, rng.choice(["%s", "%s ", "\t%s"]) % " ".join(w)))
            i += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, words(rng, 3000)), (904, "A b C d"), (905, "a  B c\nD")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, rows).repartition(4), n=n).collect()}
    assert got == brute_components(rows, n)


def test_near_duplicates_of_sizes_unlike_the_pivots(spark):
    # x is similar to 300 of its subsets and to one text around it, which no subset is similar to
    rng = random.Random(12)
    rows, i = [], 0
    for _ in range(3):
        x = [w + str(k) for k, w in enumerate(words(rng, 120).split())]
        group = [x + [w + str(-k - 1) for k, w in enumerate(words(rng, 25).split())], x] + [rng.sample(x, 100) for _ in range(300)]
        rows += [(i + k, " ".join(w)) for k, w in enumerate(group)]
        i += 1000
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows).repartition(4), n=1).collect()}
    assert got == {k: k // 1000 * 1000 for k, _ in rows}


def test_texts_of_one_template_meet_as_often_as_they_are(spark, monkeypatch):
    """60 words in common and 40 of their own: no link, and what meets doubles with the texts. With some near copies planted."""
    kept = {}
    save = near_dup.Scratch.save

    def saved(self, df, name):
        kept[name] = save(self, df, name)
        return kept[name]

    monkeypatch.setattr(near_dup.Scratch, "save", saved)
    template, met = words(random.Random(0), 60), {}
    for n in (250, 500, 1000):
        rng = random.Random(n)
        rows = [(i, f"{template} {words(rng, 40)}") for i in range(n)]
        rows += [(n + i, rows[i][1] + " more") for i in range(10)]
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows), n=1).collect()}
        assert got == {i: i - n if i >= n else i for i, _ in rows}
        met[n] = kept["pairs"].agg({"n": "sum"}).first()[0] or 0, kept["met"].count(), kept["measured"].count()
    assert met[1000][0] <= 2.5 * met[500][0] + 50 and met[1000][1] <= 3 * met[500][1] + 50 and met[1000][2] <= 3 * met[500][2], met


def test_far_members_are_found_by_their_rarest_shingles(spark):
    """All pairs of at least the similarity share one, whatever the sizes."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**63, 400).astype(np.uint64)
    sets = []
    for i in range(60):
        own = np.concatenate((rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(1, 2**63, rng.integers(0, 8)).astype(np.uint64)))
        sets += [np.unique(own), np.unique(own[: max(1, len(own) - rng.integers(0, 4))])]
    df = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, cluster long, shingles binary")
    for percent in (50, 80, 100):
        first = {}
        for r in near_dup._rarest(df, percent).collect():
            first.setdefault(r.node, set()).add(r.shingle)
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    assert first[i] & first[j]


@pytest.mark.parametrize(("n", "block", "home"), [(1, 3, 5), (2, 3, 5)])
def test_near_duplicates_in_small_blocks_and_homes(spark, n, block, home):
    rng = random.Random(17)
    rows, i = [], 0
    for size in (12, 30, 60):
        base = [w + str(k) for k, w in enumerate(words(rng, size).split())]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, size // 5)):
                w[rng.randrange(size)] = words(rng, 1)
            rows.append((i, " ".join(w)))
            i += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, rows).repartition(4), n=n, block_nodes=block, home_nodes=home).collect()}
    assert got == brute_components(rows, n)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(18)
    a, b = words(rng, 40), words(rng, 40)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " x"), (4, None), (4, None), (5, ""), (None, a + " y"), (None, "z z z"), (None, "other"), (6, None)]
    table = docs(spark, rows).withColumnsRenamed({"lang": "id", "source": "hash"})
    out = near_dup.keep_one(table)
    assert out.columns == table.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    one = Counter({(1, a): 1, (4, None): 1, (5, ""): 1, (6, None): 1, (None, "z z z"): 1, (None, "other"): 1})
    assert got in (one + Counter([(3, b)]), one + Counter([(3, b + " x")]))
    assert near_dup.keep_one(table.limit(0)).count() == 0


def test_near_duplicates_edge_cases(spark):
    got = near_dup.near_duplicates(docs(spark, EDGE)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter({(1, 1, True): 1, (2, 2, True): 1, (3, 3, True): 1, (4, 4, True): 2, (None, 4, False): 1, (5, 5, True): 1})
    assert near_dup.near_duplicates(docs(spark, EDGE).limit(0)).count() == 0


def test_word_hashes_follow_the_definition():
    texts = [b"Hello  World\tfoo\x0bBAR\x1cx", b"", b" \n", "É é A a".encode(), b"hello"]
    h, bounds = word_hashes(texts)
    flat = [w for t in texts for w in t.lower().split()]
    assert [bounds[k + 1] - bounds[k] for k in range(len(texts))] == [len(t.split()) for t in texts]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert len(shingle_set(h[:3], 2)) == 2 and len(shingle_set(h[:1], 2)) == 1 and len(shingle_set(h[:0], 2)) == 0


# vector search


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=24).round(1)], 0) for i in range(300)]
    rows += [(400, None, 0), (450, [1.0, None], 0), (451, [float("nan")] * 24, 0), (None, [1.0] * 24, 0), (500, [2.0, 3.0], 0), (501, [1.0, 1.0], 0), (501, [1.0, 2.0], 0), (550, [], 0), (551, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vector_search.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows[:300]}
    want = {(500, 1): (501, 512 * 256 + 768 * 512), (500, 2): (501, 512 * 256 + 768 * 256), (550, 1): (551, 0)}
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert vector_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_huge_components_stay_exact():
    x = np.array([[1e30, 0.0], [3.0, 2**40]])
    assert vector_search.exact(x, np.array([[1.0, 2.0**20]])).tolist() == [[2**63 - 1], [3 + 2**60]]


def test_top_k_of_many_blocks_with_ties_and_copies(spark):
    rng = np.random.default_rng(20)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, size=6)], 0) for i in range(400)] + [(i, [1.0] * 6, 0) for i in range(400, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "score")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vector_search.top_k(df, df.filter("vec_id % 2 = 0"), block_rows=11).collect()}
    want = {}
    for q in range(0, 600, 2):
        best = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(rows[q][1], v, strict=True)), i) for i, v, _ in rows if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(21)
    x, q = np.floor(256 * rng.normal(size=(50, 19))), np.floor(256 * rng.normal(size=(7, 19)))
    for s in vector_search.SEGMENTS:
        a, b = (np.concatenate(vector_search.statistics(v, s), axis=1) for v in (x, q))
        assert (a @ b.T >= x @ q.T - 1e-3).all()


# toxicity


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(7)
    stems = ["vermox", "quisling", "drabblat"]
    rows, labels = [], []
    for i in range(900):
        text, toxic = words(rng, rng.randint(20, 120)).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(stems) + words(rng, 1)[:2]
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    table = docs(spark, [*rows, (5000, None), (5001, ""), (None, "vermox")])
    model = toxicity.train(table, spark.createDataFrame([*labels, (None, 0, 1), (7777, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(table.withColumnRenamed("lang", "score"), model).select("doc_id", "score", "predicted", toxicity.held_out(table.doc_id).alias("held")).collect()
    tested = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 900]
    assert len(tested) > 120
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in tested) >= 0.97 * len(tested)
    blank = [r for r in got if r.doc_id in (5000, 5001)]
    assert len({r.score for r in blank}) == 1 and 0 <= blank[0].score <= 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, EDGE), none)
    assert {r.predicted for r in toxicity.score(docs(spark, EDGE), model).collect()} == {0}
    assert toxicity.score(docs(spark, EDGE).limit(0), model).count() == 0


def test_features_do_not_cross_texts():
    texts = ["", "ab", "", "cdefg hij", "x" * 3]
    of, feature = toxicity.features(texts)
    for i, t in enumerate(texts):
        assert sorted(feature[of == i].tolist()) == sorted(toxicity.features([t])[1].tolist())


def brute_grams(text):
    t = f" {''.join(c.lower() if c < chr(128) else c for c in text)} ".translate({c: " " for c in range(9, 14)})
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def test_features_are_the_grams_of_code_points():
    rng = random.Random(14)
    texts = ["".join(rng.choice("aAbé日本\U0001f600 \n\tz") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    grams = sorted({g for t in texts for g in brute_grams(t)})
    own = {}  # the hash of a gram, from a text that is no more than it
    of, feature = toxicity.features(texts)
    for i, t in enumerate(texts):
        mine = set(feature[of == i].tolist())
        # every n-gram that two texts share is a shared feature, and no text has more features than n-grams
        assert len(mine) <= len(brute_grams(t)) and len(mine) >= len(brute_grams(t)) - 3
        for g in brute_grams(t):
            own.setdefault(g, set(mine)).intersection_update(mine)
    assert all(own[g] for g in grams)


def test_weights_are_scaled_by_log_count_ratios():
    rng = random.Random(15)
    texts = [words(rng, 6) + (" vermox" if i % 3 == 0 else "") for i in range(240)]
    toxic = np.array([i % 3 == 0 for i in range(240)])
    model = toxicity.fit([toxicity.features([t])[1] for t in texts], toxic)
    gram = np.intersect1d(toxicity.features(["vermox"])[1], np.flatnonzero(model.weights))
    _, feature = toxicity.features(texts)
    for f in gram:
        have = np.array([f in toxicity.features([t])[1] for t in texts])
        a, b = (have & toxic).sum(), (have & ~toxic).sum()
        ratio = np.log((a + 1) / (toxic.sum() + 2)) - np.log((b + 1) / ((~toxic).sum() + 2))
        assert np.sign(model.weights[f]) == np.sign(ratio)
    assert len(gram) > 5
    for t, score in zip(texts, model.score(texts), strict=True):
        z = model.bias + sum(model.weights[f] for f in set(toxicity.features([t])[1].tolist()))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


# mixing


def water(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= limit * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_taken(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 30)), rng.choice([None, "b", "a", "Z", "é", "z"] + ["hot"] * 6)) for i in range(4000)]
    rows += [(9000, None, "empty"), (9001, "  ", "empty"), (9002, "w " * 4, "tiny")]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = water(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.15 * t, 5), s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()), key=str)
    copies = {r.doc_id: r.copies for r in got}
    assert Counter(r.doc_id for r in mixing.emit(docs(spark, rows)).collect()) == Counter({i: c for i, c in copies.items() if c})


def test_mixing_edge_cases(spark):
    assert mixing.mix(docs(spark, EDGE).limit(0)).count() == 0
    assert mixing.mix(docs(spark, EDGE)).count() == len(EDGE)
    assert {r.taken for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()} == {0}


# byte-pair encoding


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pairs = bpe.BytePairs.load(path, public_tokenizers.PATTERN)
    return path, pairs, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def test_bpe_against_the_library(spark, vocabulary):
    path, pairs, own = vocabulary
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab é日\U0001f600'\n\t.1<|>") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 30_000), (103, "<|endoftext|> it's"), (104, words(rng, 3000)), (None, "x"), (104, "again")]
    got = Counter(tuple(r) for r in bpe.round_trip(docs(spark, rows), path, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))] += 1
    assert got == want
    encoded = bpe.encode_documents(docs(spark, rows), path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    assert bpe.round_trip(docs(spark, rows).limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_pieces_that_nothing_merges(spark, vocabulary):
    """Every code point alone in its batch, pairs of odd ones, and a warm worker whose only new piece has no merge."""
    path, pairs, own = vocabulary
    encode = own.encode_ordinary
    rng = random.Random(3)
    alone = [chr(c) for c in (*range(0x3000), *(rng.randrange(0x3000, 0xD800) for _ in range(2000)), *(rng.randrange(0xE000, 0x110000) for _ in range(2000)))]
    both = ["QJ", "\x00\x01", "\x80", "\u1300", "\ua66e", "ab\u0300", *(rng.choice(alone) + rng.choice(alone) for _ in range(2000))]
    for t in alone + both:
        assert list(pairs.encode([t])) == [encode(t)], repr(t)
        assert pairs.encode_pieces([t.encode()])
    warm = bpe.BytePairs(pairs.ranks, public_tokenizers.PATTERN)
    for t in ("warm up", "QJ", "QJ warm", "\x00\x01"):
        ((n, _, raw),) = warm.digests([t])
        assert (n, raw) == (len(encode(t)), hashlib.sha256(t.encode()).hexdigest())
    rows = bpe.round_trip(docs(spark, [(1, "QJ")]).withColumn("doc_id", F.lit(1)), path, public_tokenizers.PATTERN).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 2)]


def test_remembered_pieces_do_not_change_results(vocabulary):
    _, pairs, own = vocabulary
    small = bpe.BytePairs(pairs.ranks, public_tokenizers.PATTERN, remembered=3)
    texts = [words(random.Random(10 + k % 2), 100) for k in range(4)]
    for _ in range(3):
        got = [d for t in texts for d in small.digests([t])]
        assert got == list(pairs.digests(texts)) and [d[0] for d in got] == [len(own.encode_ordinary(t)) for t in texts]


def test_queue_takes_the_least_rank_and_then_the_leftmost(vocabulary):
    _, pairs, _ = vocabulary
    rng = random.Random(16)

    def plain(piece, ranks):
        parts = [bytes([x]) for x in piece]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    # a vocabulary in which merges open pairs of lower rank and pairs overlap
    few = {bytes([x]): x for x in range(256)}
    odd = [b"abc", b"aab", b"bcab", b"ab", b"aa", b"bc", b"aaa", b"cab", b"aaaa", b"abab", b"abcabc", b"ba"]
    few |= {b: 256 + k for k, b in enumerate(odd)}
    own = bpe.BytePairs(few, public_tokenizers.PATTERN)
    pieces = ["".join(rng.choice("aaabc") for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    assert own.encode_pieces(pieces) == [plain(p, few) for p in pieces]
    pieces = ["".join(rng.choice("theinraé ") for _ in range(rng.randint(1, 80))).encode() for _ in range(200)]
    assert pairs.encode_pieces(pieces) == [plain(p, pairs.ranks) for p in pieces]
