"""Main text of pages, the trie of conversation prefixes and periodic runs, against brute force."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from undertow.llm import html_text, prefix_trie, runs

PAGES = [
    ("marked", '<nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some <b>bo</b>ld words<br>here &amp; there.<p>Short.</article><footer>x y z</footer>', "T Some bold words here & there. Short."),
    (
        "by clusters",
        '<div class="top-menu"><ul><li><a href=x>Home</a><li><a>About us</a></ul></div><div><h1>Title of it</h1><p>A long paragraph of text that says things.<p>Short.'
        "<p>Another long paragraph of text &lt;here&gt;.</div><div id=sidebar><p>See also this long text about other things entirely.</div><form><p>Name <input></form>"
        '<section id="comments"><p>I think this is a wonderful article, thanks!</section>',
        "Title of it A long paragraph of text that says things. Short. Another long paragraph of text <here>.",
    ),
    ("main", "<main><p>One <i>t</i>wo</p><aside>x</aside></main><div><p>Other text that is long and outside of the main element</div>", "One two"),
    ("comments inside", '<article><p>Body here.</p><div class="ad-box">Buy!</div><section class=comments><article><p>First!</p></article></section></article>', "Body here."),
    ("notice", '<div class="cookie-notice"><p>We use many cookies on this wonderful site of ours.</p></div><p>Short text.', "Short text."),
    ("unclosed", "<article><p>a<p>b<div>c</b></i></div></p>d", "a b c d"),
    ("stray", "<div><p>hello</span></div></div></p>world", "hello world"),
    ("scripts", '<p>one<script>var t="</p>two";</script><style>p{}</style><!-- three --><noscript>four</noscript><p>five', "one five"),
    ("cut", "<article><p>text of it<!-- never closed <p>gone", "text of it"),
    ("cut tag", "<article><p>text of it<a href='x", "text of it"),
    ("references", "<p>&lt;tag&gt; &eacute;&#233;&#x41; a&nbsp;b &am", "<tag> ééA a b &am"),
    ("links only", "<ul><li><a>a</a><li><a>b</a></ul>", "a b"),
    ("plain", "no tags at all", "no tags at all"),
    ("empty", "", ""),
    ("null", None, ""),
    ("silent", "<script>x</script>", ""),
]


def test_main_text(spark):
    rows = [(k, name, html, "x", 1) for k, (name, html, _) in enumerate(PAGES)] + [(None, None, "<p>a", "x", 1), (0, "marked", PAGES[0][1], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `k0` int")
    got = html_text.html_query(df).collect()
    want = [(k, name, text) for k, (name, _, text) in enumerate(PAGES)] + [(None, None, "a"), (0, "marked", PAGES[0][2])]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r["page_id"], r["url"], r["text"]) for r in got], key=order) == sorted(want, key=order)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.html_query(df.filter("false")).count() == 0


def test_every_short_block_of_an_article_stays():
    rng = random.Random(2)
    for _ in range(60):
        blocks = [" ".join(rng.choice(["a", "long", "wording"]) for _ in range(rng.choice([1, 2, 40, 200]))) for _ in range(rng.randrange(1, 30))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        for opened, closed in (("<article>", "</article>"), ("<div>", "</div>")):
            page = f"<body><nav><ul><li><a href=1>One</a></li></ul></nav>{opened}{body}{closed}<footer>foot of it</footer></body>"
            assert html_text.main_text(page) == " ".join(blocks)


@pytest.mark.parametrize("part", ["<div>", "<p>a<b>", "<div><p>a", "<!--", "<a ", "<a b='", "<b>x</p>", "<li><ul>", "<?", "</"])
def test_broken_pages_take_linear_time(part):
    assert isinstance(html_text.main_text(part * 20_000 + "x"), str)


def brute_trie(rows):
    """rows (conv, turn, role, text) -> the nodes by the contract's words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(set)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = {x for x in below if len(x) == len(node) + 1}
        ends = sorted(c for c in who if len(whole[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids),
            sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in below) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def talks(seed, n=60):
    rng, rows = random.Random(seed), []
    for k in range(n):
        conv = rng.choice([k, 100 + k, 200 + k, 5000 + k])
        if rng.random() < 0.2:
            conv -= conv % 100
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "bot", None]), rng.choice(["hi", "a b", "", None, "é\U0001f600"])))
    return [*{(c, t): (c, t, r, x) for c, t, r, x in rows}.values(), (None, 1, "user", "hi")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [{}, {"shards": 4, "least": 3}, {"shards": 50, "least": 1, "queue": 4}])
def test_trie(spark, options):
    rows = talks(len(options))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", kx int, depth string")
    turns = prefix_trie.ordered_turns(df, "conv_id", "turn", "role", "text")
    got = sorted(tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(turns), **options).collect())
    assert got == sorted(brute_trie(rows))


def test_trie_of_long_and_repeated_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    long = [(300, t, "user", f"t{t % 7}") for t in range(50)] + [(400, t, "user", f"t{t % 7}") for t in range(50)]
    rows = long + [(500 + c, t, "bot", "same" * (t + 1)) for c in range(20) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in prefix_trie.trie_query(df).collect()) == sorted(brute_trie(rows))
    twice = spark.createDataFrame([(7, 0, "user", "a"), (7, 0, "user", "a")], SCHEMA)  # repeated rows are two turns
    assert max(r["depth"] for r in prefix_trie.trie_query(twice).collect()) == len(brute_trie([(7, 0, "user", "a")] * 2)) - 1
    assert prefix_trie.trie_query(df.filter("false")).count() == 0
    assert prefix_trie.trie_query(spark.createDataFrame([(None, 0, "user", "a")], SCHEMA)).count() == 0


def test_spilling_queue_is_a_queue():
    rng = random.Random(3)
    queue, held = prefix_trie.SpillingQueue(5), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            assert queue.head() == min(held) == queue.pop()
            held.remove(min(held))
        else:
            item = (rng.randrange(20), rng.randrange(1 << 60), rng.randrange(9))
            held.append(item)
            queue.push(item)
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.head() is None


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(12, 2 * q) and not any(part[k:] == part[:-k] for k in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(2500):
        n = rng.randrange(0, 90)
        words = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(n)]
        for _ in range(rng.randrange(0, 4)):
            if n >= 6:
                p, s = rng.randrange(1, n // 2 + 1), rng.randrange(0, n - 1)
                for i in range(s + p, min(n, s + p * rng.randrange(2, 6) + rng.randrange(5))):
                    words[i] = words[i - p]
        assert runs.runs_of(np.array(words, np.int64)) == brute_runs(words), words


def test_runs_of_hard_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.runs_of(np.array(b, np.int64)) == brute_runs(b)  # many runs inside runs
    assert runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_runs_query(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["a", "b", "É", "d e", "f"]) for _ in range(rng.choice([0, 3, 30, 90])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "x\x0by " * 20), (203, "x\x0by " * 20), (None, "z " * 30), (-5, "q w e " * 9), (204, "tok " * 30_000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, id string")
    got = sorted([tuple(r) for r in runs.runs_query(df).collect()], key=str)
    want = []
    for i, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute_runs(words) if n < 1000 else [(0, n, 1)]
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(found), *head, sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert runs.runs_query(df.filter("false")).count() == 0
    assert {r["text"] for r in runs.collapse(df.filter("doc_id = 203")).collect()} == {"x y"}
