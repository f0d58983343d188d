import random
import re
from datetime import datetime, timedelta

from twinbuild.llm.decontamination import contaminated, without_leaks
from twinbuild.llm.url_filter import url_verdicts, validity


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def shared(text, item):
    """The item's shingles that a text holds: windows of five words, or of the item's own length where that is less."""
    w, n = words_of(text), min(len(words_of(item)), 5)
    return shingles(item) & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randint(0, 300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((2, 4, 8, 20, 45, 90))))) for k in range(40)]
    docs = []
    for k in range(150):
        words = [word() for _ in range(rng.randint(0, 120))]
        if k % 3 == 0:
            piece = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                piece[rng.randrange(len(piece))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = piece
        docs.append((k, ("  ".join(words)).upper() if k % 2 else ", ".join(words)))
    docs.append((200, items[0][1]))
    want = {(d, i): len(shared(t, x)) for d, t in docs for i, x in items if shingles(x) and 5 * len(shared(t, x)) >= 4 * len(shingles(x))}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for few in (100_000, 0):
        assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in contaminated(d, b, broadcast_items=few).collect()} == want
    assert {r["doc_id"] for r in without_leaks(d, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_no_python_on_the_way(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    plan = contaminated(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_leak_cases(spark, odd, nothing):
    items = spark.createDataFrame([(1, "a b c d e f"), (None, "one two"), (2, None), (3, ""), (4, "One, two!")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(odd, items).collect()} == {(5, 1), (6, 1), (4, 4)}
    assert contaminated(nothing, items).collect() == [] and contaminated(odd, items.limit(0)).collect() == []
    assert without_leaks(odd, items).columns == odd.columns


START = datetime(2024, 1, 1)


def test_verdicts_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.net", "deep.a.example.com"]
    patterns = [*hosts, ".example.com", ".a.example.com", ".net", "a.example.com/p", "a.example.com/p/q", "x.net/p"]
    entries = [(rng.choice(patterns), rng.choice(["block", "allow"]), START + timedelta(days=rng.randint(0, 150), hours=rng.choice((0, 7))), rng.choice(["add", "add", "remove"])) for _ in range(120)]
    captures = [(k, f"https://{rng.choice(['', 'www.', 'u@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p', '/p/q', '/pp', '/p//q/r'])}{rng.choice(['', '?a=/p', '#x'])}", START + timedelta(days=rng.randint(0, 160), minutes=rng.randint(0, 999))) for k in range(200)]
    want = {}
    for k, url, t in captures:
        m = re.match(r"https://(?:u@)?(?:www\.)?([^/:?#]+)(?::80)?([^?#]*)", url)
        host, path = m[1], [p for p in m[2].split("/") if p]
        active = []
        for pattern, action in {(e[0], e[1]) for e in entries}:
            whole = "/".join([host, *path]) + "/"
            fits = pattern == host or pattern.startswith(".") and ("." + host).endswith(pattern) or "/" in pattern and whole.startswith(pattern + "/")
            past = [e for e in entries if e[:2] == (pattern, action) and e[2] <= t]
            if fits and past and all(e[3] == "add" for e in past if e[2] == max(x[2] for x in past)):
                active.append((2 if "/" in pattern else 0 if pattern[0] == "." else 1, len(pattern), action == "allow", pattern, action))
        best = max(active, default=None)
        want[k] = (len(active), best[3] if best else None, best is None or best[4] == "allow")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame(entries, "pattern string, action string, changed_at timestamp, op string")
    for few in (100_000, 0):
        got = url_verdicts(c, e, broadcast_spans=few)
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
        assert {r["page_id"]: (r["n_active"], r["pattern"], r["kept"]) for r in got.collect()} == want


def test_verdict_cases(spark):
    c = spark.createDataFrame([(1, None, START), (2, "", START), (3, "no host", START), (4, "http://a.b/", None), (None, "http://A.b", START), (5, "//a.b/x", START), (5, "//a.b/x", START)], "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame([("a.b", "block", START, "add"), (None, "block", START, "add"), ("a.b", None, START, "add"), ("a.b", "block", None, "remove"), ("a.b", "block", START, "add")], "pattern string, action string, changed_at timestamp, op string")
    got = [(r["page_id"], r["kept"], r["n_active"]) for r in url_verdicts(c, e).collect()]
    assert sorted(got, key=str) == sorted([(1, True, 0), (2, True, 0), (3, True, 0), (4, True, 0), (None, False, 1), (5, False, 1), (5, False, 1)], key=str)
    assert all(r["kept"] for r in url_verdicts(c, e.limit(0)).collect()) and url_verdicts(c.limit(0), e).collect() == [] and validity(e).count() == 1


def test_short_items_inside_documents(spark):
    """Items of one to four words are found wherever they stand, against a search through every document."""
    import random
    import re

    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice("abcdefgh") + rng.choice(["", ",", ". "]) for _ in range(rng.choice([0, 1, 2, 4, 30])))) for k in range(40)] + [(40, "well, What is two plus? yes"), (41, None)]
    items = [(1, "What is two plus"), (2, "a b"), (3, "c"), (4, "h g f"), (5, "zebra"), (6, "two  plus"), (7, ""), (8, "a b c d e f g")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = set()
    for d, t in texts:
        w = words(t)
        for i, x in items:
            v = words(x)
            n = min(len(v), 5)
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if own and 100 * len(own & windows) >= 80 * len(own):
                want.add((d, i))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert found == want and (40, 1) in want and len(want) > 10
