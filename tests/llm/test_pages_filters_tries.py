"""Main text, filter audit and conversation trie against plain versions, with nulls, empty and long texts, ties,
repeats, empty tables and columns whose names clash with inner ones."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from shoplake.llm import filter_audit, main_text, prefix_trie

LONG = "Words of the article, one after another; and a stop. " * 30


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    (None, ""), ("", ""), ("plain text &amp; more", "plain text & more"),
    (page("<nav><ul><li><a href='/a'>a</a></ul></nav><div class=ad>Buy now, it is good.</div><article><h1>Title &eacute;</h1>"
          "<p><b>Bold<br>x<p>Two  \n words</article><footer>&copy; x</footer>"), "Title é\n\nBold x\n\nTwo words"),
    # no marked article: path ratios decide; the comments are longer than the text
    (page(f"<div id=top><span>My site</span></div><div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div id=text>"
          f"<h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><span>tiny</span></div><div id='comments'><p>{LONG * 4}</p></div>"),
     f"Head\n\n{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"),
    (page("<form><main><p>In a form.</p></main><input><select><option>o</select></form><aside>Side, text.</aside>"), "In a form."),
    (page("<article><header><h2>H</h2></header><p>Body.</p><section class='comments'><article class=comment><p>No.</p></article>"
          "</section><aside>Side.</aside><div hidden>h</div></article>"), "H\n\nBody."),
    (page(f"<article><p>{LONG * 3}</p></article><section><article class=card><p>Teaser.</p></article></section>"), (LONG * 3).strip()),
    ("<article><p>cut <b", "cut"), ("<p>a < b &am c<script>if (a<b) '</p>'</script></p>", "a < b &am c"),
    (page("<nav>only a menu</nav><script>x</script>"), ""),
    (page("<div class=cookie-notice><p>We use cookies, yes.</p></div><article class='post has-comments'><p>Kept.</p></article>"), "Kept."),
    ("<article><ul><li><a>m1</a><li><a>m2</a></ul><p>See <a>this link</a> and that.</article>", "See this link and that."),
]


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", h, "t", 1, "p") for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows + rows[3:4] + [(None, None, "<p>x</p>", "t", 1, "p")],
                               "page_id long, url string, html string, text string, n_chars int, path string")
    got = main_text.extract_pages(df).collect()
    assert len(got) == len(PAGES) + 2
    for r in got:
        if r["page_id"] is None:
            assert (r["url"], r["text"], r["n_chars"]) == (None, "x", 1)
            continue
        want = PAGES[r["page_id"]][1]
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == f"u{r['page_id']}"
    assert main_text.extract_pages(df.limit(0)).count() == 0


def test_main_text_of_long_and_broken_pages():
    many = "".join(f"<p>Paragraph {i}, of text." for i in range(60_000))
    assert main_text.main_text(f"<article>{many}").count("\n\n") == 59_999
    for odd in ("<div>" * 30_000 + "x", "<a href=\"" * 5_000, "<p><b>" * 30_000, "<" * 100_000, "<!" * 50_000,
                "<div class=ad>" * 20_000, "</p>" * 20_000 + "&#xD800;&#0;"):
        main_text.main_text(odd)


def audit_plain(docs, labels):
    """Every document through every order, one after another."""
    out = {}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {s or "" for _, _, s in docs}:
        fails = []
        for i, t, s in docs:
            if (s or "") != part:
                continue
            t = t or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            f = {c for c, x in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if x}
            fails.append((i, f))
        power = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            kept = fails
            for step, c in enumerate(order, 1):
                gone = [d for d in kept if c in d[1]]
                kept = [d for d in kept if c not in d[1]]
                power[c] += len(gone)
                rows[order, step] = [len(kept), len(gone), sum(c in f for _, f in fails) - len(gone), sum(f == {c} for _, f in fails),
                                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (order, step), row in rows.items():
            out[part, order, step] = [*row, power[order[step - 1]]]
    return out


def test_filter_audit_equals_every_order_by_hand(spark):
    dice = np.random.default_rng(3)
    texts = [None, "", "A B", "word " * 250, " ".join(f"w{i}" for i in range(300)), "x # y", "$" * 10,
             " ".join(f"W{i}" for i in range(300)), " ".join(f"v{i} %" for i in range(250)), "é è\x0b" * 300, "long " * 300_000]
    docs = [(int(dice.integers(0, 60)) if k % 9 else None, texts[k % len(texts)], [None, "", "s1", "s2"][int(dice.integers(4))])
            for k in range(90)]
    labels = [(int(i), [0, 1, None][int(dice.integers(3))], [0, 1, None][int(dice.integers(3))]) for i in dice.integers(0, 60, 50)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "m", 2) for d in docs], "doc_id long, text string, source string, mask int, part string, step int")
    marks = spark.createDataFrame([(*r, "d") for r in labels], "doc_id long, quality int, toxic int, digest string")
    got = filter_audit.audit(frame, marks).collect()
    want = audit_plain(docs, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]]
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert filter_audit.audit(frame, marks.limit(0)).where("good_lost > 0").count() == 0


def trie_plain(rows, mixed):
    """conv_id -> turns; nodes by prefix."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:] if mixed else turns[c]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                  for p, m in nodes.items())


def conversations(seed):
    dice = np.random.default_rng(seed)
    rows = []
    for c in range(80):
        if c % 11 == 3:
            continue
        n = int(dice.integers(0, 12)) if c != 42 else 70
        for t in range(n):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, ["user", "assistant", None][t % 3],
                         ["hi", "", None, "é" * 3, "long " * 50][int(dice.integers(0, 2 if c % 2 else 5))]))
    return rows + rows[:5] + [(None, 1, "user", "x"), (200, 0, "user", "hi"), (201, 0, "user", "hi"), (202, 0, "user", "hi")]


@pytest.mark.parametrize("stretch, container", [(512, 512), (3, 4), (4, 1), (1, 2), (5, 1000)])
def test_trie_equals_all_prefixes(spark, stretch, container):
    rows = conversations(stretch)
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, pos int, head string")
    turns, convs = prefix_trie.spliced(prefix_trie.turn_ids(df), 5, 9)
    got = prefix_trie.trie_nodes(turns, convs, stretch, container)
    assert sorted(tuple(r)[:8] for r in got.collect()) == trie_plain(rows, True)


def test_trie_of_plain_conversations(spark):
    rows = conversations(9) + [(300, 0, "user", "x" * 2_000_000), (301, 0, "user", "x" * 2_000_000)]
    schema = "conv_id long, turn long, role string, text string"
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r)[:8] for r in got) == trie_plain(rows, False)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
