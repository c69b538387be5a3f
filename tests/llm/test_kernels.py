"""What the corpus operators do per text or per shard, against brute force; no Spark."""

import heapq
import itertools
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kinlink.llm import chat_repair, html_extract, quality_llr, simhash_dedup, source_mix, substring_dedup, toxicity_grammar, warc_derive


def made_docs(rng, n):
    parts = ["th", "an ", "re", "on ", "in", "er ", "ab", "the ", "xx"]
    base = "".join(rng.choice(parts) for _ in range(300))
    docs = []
    for _ in range(n):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        k = rng.random()
        if k < 0.4:
            a = rng.randint(0, len(base) - 100)
            t = t + base[a : a + rng.randint(40, 160)] + t[:20]
        elif k < 0.5:
            t = "ab" * rng.randint(10, 90)
        elif k < 0.6 and docs:
            t = rng.choice(docs)[1].decode()
        elif k < 0.65:
            t = "é" * rng.randint(20, 60)
        docs.append((rng.randint(0, n), t.encode()))
    return docs


def removed_brute(docs):
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in docs:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                m[i : i + 50] = True
        out.append(m)
    return out


def by_hand(docs, routes, hot):
    """The keys that keyed() gives, without Spark."""
    by = substring_dedup.Keys(routes * substring_dedup.FINE, [])
    for _ in range(2):
        rows = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t.decode() for _, t in docs]})
        total = Counter()
        for batch in substring_dedup._weigh(by)(iter([rows])):
            for part, n in zip(*(c.to_pylist() for c in batch.columns)):
                total[part] += n
        found = np.array(sorted(p for p, n in total.items() if n > hot), np.uint64)
        if not len(found):
            break
        by = substring_dedup.Keys(routes * substring_dedup.FINE, [*by.hot, found])
    return by


@pytest.mark.parametrize("hot", [0, 150, 1 << 30])
@pytest.mark.parametrize("chunk", [700, 1 << 20])
def test_substring_removal_is_exact(chunk, hot, monkeypatch):
    whole = substring_dedup.resolve
    monkeypatch.setattr(substring_dedup, "resolve", lambda pieces: whole(pieces, chunk))
    rng = random.Random(3)
    for _ in range(20 if hot > 1000 else 4):
        docs = made_docs(rng, rng.randint(1, 80))
        batches = []
        by = by_hand(docs, 1, hot) if docs else None
        for half in (docs[::2], docs[1::2]):
            if half:
                rows = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in half], "text": [t.decode() for _, t in half]})
                batches += substring_dedup._spread(1, by)(iter([rows]))
        got = defaultdict(list)
        if batches:
            for r in substring_dedup._gather(pa.Table.from_batches(batches, schema=substring_dedup._SENT)).to_pylist():
                got[r["doc_id"], r["crc"]].append((r["s"], r["e"]))
        for (d, t), expected in zip(docs, removed_brute(docs)):
            m = np.zeros(len(t), bool)
            for s, e in got[d, zlib.crc32(t)]:
                m[s:e] = True
            assert (m == expected).all()


def test_a_common_gram_does_not_fill_a_shard():
    """One gram in every line, which is the minimizer of nearly all windows: its share of what is sent falls with the number of documents."""
    rng = random.Random(9)
    low = min((bytes(rng.choices(b"abcdefghijklmnop", k=8)) for _ in range(200_000)), key=lambda g: int(substring_dedup._mix(np.array([int.from_bytes(g)], np.uint64))[0]) >> 32)
    shares = []
    for n in (400, 1600):
        docs = [(i, b" ".join(bytes(rng.choices(b"abcdefghijklmnop", k=12)) + low for _ in range(12))) for i in range(n)]
        for hot in (1 << 30, 20_000):
            by = by_hand(docs, 8, hot)
            _, _, lens, keys, _ = substring_dedup.cut([t for _, t in docs], by)
            by_key = Counter()
            for k, size in zip(keys.tolist(), lens.tolist()):
                by_key[k] += size
            shares.append(max(by_key.values()) / sum(lens.tolist()))
    assert shares[0] > 0.5 and shares[2] > 0.5 and shares[1] < 0.05 and shares[3] < 0.6 * shares[1]


def test_a_large_shard_solves_only_windows_of_two_documents(monkeypatch):
    """A shard of several chunks sorts what two documents may share, not all of its windows."""
    rng = random.Random(11)
    shared = rng.randbytes(80)
    texts = [rng.randbytes(3000) for _ in range(40)]
    texts[5], texts[31] = shared + texts[5], texts[31] + shared
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = substring_dedup.Pieces(b"".join(texts), sizes, np.arange(40), np.zeros(40, np.int64), np.zeros(40, np.int64))
    solved, whole = [], substring_dedup.Shard.solve
    monkeypatch.setattr(substring_dedup.Shard, "solve", lambda self, places: (solved.append(len(places)), whole(self, places))[1])
    assert substring_dedup.resolve(pieces, 20_000) == [(31, 0, 3000, 3080)]
    assert sum(solved) == 2 * 31


def test_a_flush_sends_all_routes_in_one_batch():
    rng = random.Random(12)
    docs = [(i, rng.randbytes(400)) for i in range(30)]
    box = substring_dedup.Outbox(50, substring_dedup.Keys(50 * substring_dedup.FINE, []))
    box.take(docs)
    sent = list(box.batches())
    assert len(sent) == 1 and len(set(sent[0].column("route").to_pylist())) == sent[0].num_rows > 40
    found = list(substring_dedup._unpack(sent[0].column("blob").to_pylist()))
    held = [(d, p.data[a : a + n], o) for p in found for d, a, n, o in zip(p.docs.tolist(), (np.cumsum(p.sizes) - p.sizes).tolist(), p.sizes.tolist(), p.offs.tolist())]
    assert len(held) == sum(len(p.sizes) for p in found) > 100 and all(docs[d][1][o : o + len(x)] == x for d, x, o in held)


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for _ in range(20):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 200)))
        order, _ = substring_dedup.suffix_array(np.frombuffer(t, np.uint8), depth=256)
        assert [int(i) for i in order] == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = substring_dedup.common_prefixes(np.frombuffer(t, np.uint8), order, cap=50)
        for a, b, n in zip(order, order[1:], lcp[1:]):
            x, y = t[a:], t[b:]
            assert n == min(50, next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))


def test_merged_runs():
    assert substring_dedup.merge([(5, 9), (0, 5), (20, 30), (22, 25)]) == [(0, 9), (20, 30)]
    assert substring_dedup.merge([]) == []


def fingerprint_brute(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b", "The aÉ İb c", "x " * 40000, "a b c d e", "A b C d E f"])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == fingerprint_brute(text)


def test_rules_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b ", "c\n", "d d ", "é#", " ", "\n", " ", "*|<"]) for _ in range(rng.randint(0, 120)))
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
        assert quality_llr.rules(t) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))
    assert quality_llr.rules(None) == (0, 0, 0, 0, 0)


def test_threshold_parts_classes():
    assert 2 < quality_llr.threshold(np.array([3.0, 4.0]), np.array([1.0, 2.0])) < 3
    assert quality_llr.threshold(np.array([]), np.array([1.0])) == float("-inf")


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    t = bytes(random.Random(2).randrange(256) for _ in range(5000))
    whole = Counter(int(x) for g in quality_llr.pieces(t) for x in g)
    monkeypatch.setattr(quality_llr, "_PIECE", 700)
    assert Counter(int(x) for g in quality_llr.pieces(t) for x in g) == whole


def test_subset_sum_is_best():
    rng = random.Random(4)
    for _ in range(100):
        stock = [(rng.randint(1, 15), rng.randint(0, 3)) for _ in range(rng.randint(0, 5))]
        budget = rng.randint(0, 60)
        best = max((s for s in (sum(k * n for k, (n, _) in zip(ks, stock)) for ks in itertools.product(*(range(c + 1) for _, c in stock))) if s <= budget), default=0)
        taken = source_mix.subset(stock, budget)
        assert sum(n * k for n, k in taken.items()) == best
        have = Counter()
        for n, c in stock:
            have[n] += c
        assert all(k <= have[n] for n, k in taken.items())


def test_fit_comes_near():
    rng = random.Random(6)
    for _ in range(50):
        sizes = sorted(rng.sample(range(0, 4000), 60))
        counts = [rng.randint(1, 9) for _ in sizes]
        total = sum(s * n for s, n in zip(sizes, counts))
        target = rng.uniform(0, 3 * total)
        rounds, extra = source_mix.fit(sizes, counts, target)
        taken = rounds * total + sum(s * e for s, e in zip(sizes, extra))
        assert all(0 <= e <= n for e, n in zip(extra, counts)) and rounds + any(extra) <= 3
        assert abs(taken - target) <= 5


def test_fit_in_bounded_memory():
    sizes, counts = [1, 3, 7, 900, 30_000_000, 100_000_000], [5, 5, 5, 5, 1, 1]
    total = sum(s * n for s, n in zip(sizes, counts))
    for target in (50_000_000.0, 29_000_000.0, 31_000_000.0, 101_000_000.0, 1.9 * total, 3.0 * total):
        rounds, extra = source_mix.fit(sizes, counts, target)
        assert all(0 <= e <= n for e, n in zip(extra, counts)) and rounds * total + sum(s * e for s, e in zip(sizes, extra)) <= target + 1
    best = lambda t: source_mix.fit(sizes, counts, t)[1]
    assert best(30_000_010.0)[4] == 1 and sum(s * e for s, e in zip(sizes, best(30_000_010.0))) == 30_000_010
    dense = source_mix.fit(list(range(1, 3000)), [10_000] * 2999, 1e10)
    assert abs(dense[0] * 2999 * 1500 * 10_000 + sum(s * e for s, e in zip(range(1, 3000), dense[1])) - 1e10) <= 1


def matched(text, stems=None):
    lexer = toxicity_grammar.Lexer(stems or {})
    return {n[2:]: round(float(np.expm1(v))) for n, v in zip(toxicity_grammar.FEATURES, toxicity_grammar.features(text, lexer)) if v and n.startswith("n_")}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("you are an idiot.", {"D": 1}),
        ("an idiot.", {}),
        ("The word idiot comes from Greek.", {"q": 1}),
        ("idiot", {}),
        ("The clown performed at the circus. Nobody was hurt.", {}),
        ("an idiot you are", {"Y": 1}),
        ("you are not an idiot.", {"d": 1}),
        ("you are never stupid nor kind", {"d": 1}),
        ("he said idiot.", {"q": 1}),
        ("he is a moron", {"e": 1}),
        ("not. you idiot", {"D": 1}),
        ("IDIOT!! *** grobians", {"R": 1}),
        ("this scum and that trash", {"R": 1}),
        ("that scum. A day. Such trash.", {"R": 1}),
        ("what mildly thing. Another mildling.", {"M": 1}),
        ("you are mildly", {"d": 1}),
        ("mildly mildest", {"R": 1}),
        ("kill you", {"Y": 1}),
        ("I will kill you", {"S": 1, "Y": 1}),
        ("you, I will soon kill", {"T": 1}),
        ("you kill time", {"u": 1}),
        ("I will not kill you", {}),
        (None, {}),
        ("", {}),
        ("the quiet day", {}),
    ],
)
def test_grammar_matches(text, expected):
    assert matched(text, {"grobian": "I", "mild": "i"}) == expected


def one_by_one(symbols):
    """The five machines said as plain programs over one clause after another."""
    out, past = [], 0
    clauses = "".join(symbols).split("b")
    for clause in clauses:
        line, left = [], 0  # negation
        for c in clause:
            if c == "n":
                line.append("o")
                left = 3
                continue
            line.append({"I": "i", "i": "o", "t": "o"}.get(c, c) if left else c)
            left = max(0, left - 1)
        stems, line2 = 0, []  # insult
        for c in line:
            line2.append("X" if c == "I" or c == "i" and stems else "x" if c == "i" else c)
            stems += c in "iI"
        line, left = [], 0  # threat
        for c in line2:
            if c == "m":
                line.append("o")
                left = 4
                continue
            line.append(("W" if left else "w") if c == "t" else c)
            left = max(0, left - 1)
        quoted = False  # reported
        for i, c in enumerate(line):
            if c == "r":
                quoted, line[i] = True, "o"
            elif c in "xXwW" and quoted:
                line[i] = "q"
        named = person = pending = False  # target
        found = []
        for c in line:
            if c == "y":
                if pending and not named and not person:
                    found.append("Y")
                named, pending = True, False
            elif c == "h":
                person = person or not (named or pending)
            elif c == "q":
                found.append("q")
            elif c in "xXwW":
                if named:
                    found.append({"x": "d", "X": "D", "w": "u", "W": "T"}[c])
                elif c == "W":
                    found.append("S")
                elif c == "X" and person:
                    found.append("e")
                elif c == "X" and past:
                    found.append("R")
                elif c == "x" and past:
                    found.append("M")
                past = max(past, {"x": 1, "X": 2, "w": 0, "W": 2}[c])
                pending = pending or not (named or person)
        out.append(found)
    return out


def test_grammar_against_plain_programs():
    g = toxicity_grammar

    def automaton(symbols):
        state, out, here = 0, [], []
        for c in symbols:
            k = g.INPUT.index(c)
            if (put := g.PUT[state][k]) >= 0:
                here.append(g.OUTPUT[put])
            state = g.FOLLOW[state][k]
            if c == "b":
                out.append(here)
                here = []
        return [*out, here]

    for n in range(5):
        for symbols in itertools.product(g.INPUT, repeat=n):
            assert automaton(symbols) == one_by_one(symbols), symbols
    rng = random.Random(2)
    for _ in range(5000):
        symbols = rng.choices(g.INPUT, k=rng.randint(5, 40))
        assert automaton(symbols) == one_by_one(symbols), symbols


def test_scores_without_labels():
    texts = ["The word idiot comes from Greek.", "idiot", "She saw the clown.", "You are kind.", "", None, "You are an idiot.", "You, we will hurt.", "That scum is trash."]
    got = toxicity_grammar.scored(texts, toxicity_grammar.Lexer({}), toxicity_grammar.PRIOR) >= toxicity_grammar.CUT
    assert got.tolist() == [False] * 6 + [True] * 3


def least_repair(roles):
    queue, done = [(0, 0, chat_repair.START)], set()
    while queue:
        cost, i, s = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(roles) and s in chat_repair.ACCEPT:
            return cost
        for r in (1, 2):
            if (s, r) in chat_repair.LEGAL:
                heapq.heappush(queue, (cost + chat_repair.INSERT, i, chat_repair.LEGAL[s, r]))
        if i < len(roles):
            c = chat_repair.role_class(roles[i])
            for label in range(3):
                price = 0 if c == label else chat_repair.GUESS if c == chat_repair.UNKNOWN else chat_repair.RELABEL
                if (s, label) in chat_repair.LEGAL:
                    heapq.heappush(queue, (cost + price, i + 1, chat_repair.LEGAL[s, label]))
                if s == label + 1:
                    heapq.heappush(queue, (cost + price + chat_repair.MERGE, i + 1, s))


def legal(out):
    roles = [r for _, _, r, action, _, _ in out if not action.endswith("merge")]
    body = roles[1:] if roles and roles[0] == "system" else roles
    return body and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def test_repairs_are_legal_and_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(["system", "user", "assistant", None], repeat=n):
            out = chat_repair.repair([(i, r, "x") for i, r in enumerate(roles)])
            assert sum(x[4] for x in out) == least_repair(roles)
            assert legal(out)
            assert [x[0] for x in out if x[3] != "insert"] == list(range(n))


def test_repairs_do_not_depend_on_cuts():
    for classes in itertools.product(range(4), repeat=6):
        whole = chat_repair.path(list(classes), chat_repair.START, None)
        for size in range(1, 6):
            pieces = [classes[i : i + size] for i in range(0, 6, size)]
            summaries = [chat_repair.Summary() for _ in pieces]
            for s, p in zip(summaries, pieces):
                for c in p:
                    s.add(c)
            states = [chat_repair.START]
            for p, (entry, leave) in zip(pieces, chat_repair.through([s.numbers() for s in summaries])):
                assert entry == states[-1]
                states += chat_repair.path(list(p), entry, leave)[1:]
            assert states == whole


def test_the_first_of_equally_cheap_paths():
    def price(states, classes):
        steps = [chat_repair.moves(c).get((s, t)) for c, s, t in zip(classes, states, states[1:])]
        if None in steps:
            return None
        ends = [(cost, len(roles)) for t, (cost, roles) in chat_repair.inserts(states[-1]).items() if t in chat_repair.ACCEPT]
        cost, roles = min(ends)
        return sum(x[0] for x in steps) + cost, roles, states

    for classes in itertools.product(range(4), repeat=4):
        best = min(p for rest in itertools.product(range(4), repeat=4) if (p := price((chat_repair.START, *rest), classes)))
        assert tuple(chat_repair.path(list(classes), chat_repair.START, None)) == best[2]


def test_repair_renders():
    out = chat_repair.repair([(0, "Human", "a"), (1, "user", None), (2, "gpt", "b")])
    assert "".join(x[5] for x in out) == "<|im_start|>user\na\n\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


PAGE = """<html><head><title>No</title><script>var t="</p>"; no()</script></head><body><header>No</header><nav><a href=x>No</a></nav>
<div class="sidebar">No no no no no</div><main><article><h1>Head &amp; line</h1><p>First  <b>bold<br>next</b> part.<p>Second\n part
<div class="ad">No</div><aside>No</aside><section id="comments"><p>No</p></section></article></main><form>No</form><footer>No</footer>"""


def test_main_text():
    assert html_extract.extract(PAGE) == "Head & line\n\nFirst bold next part.\n\nSecond part"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p> </p>") == ""
    assert html_extract.extract("just text") == "just text"
    assert html_extract.extract("<nav>a</nav><div class=cookie-notice>b</div>") == ""
    deep = "<div>" * 3000 + "<p>deep</p>"
    assert html_extract.extract(deep) == "deep"


def test_warc_round_trip_and_links():
    source = warc_derive.response(7, "http://a.example/x", "<title>T &amp; U</title><p>One<p>Two <a href='/y'>link</a><script>no</script>")
    (meta, meta_block), (conv, conv_block) = warc_derive.derive(*source)
    own, m, c = dict(source[0]), dict(meta), dict(conv)
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == own["WARC-Record-ID"]
    assert m["WARC-Concurrent-To"] == c["WARC-Record-ID"] and c["WARC-Concurrent-To"] == m["WARC-Record-ID"]
    assert c["WARC-Source-Payload-Digest"] == own["WARC-Payload-Digest"]
    assert conv_block.decode().split("\n")[-2:] == ["One", "Two link"]
    assert b"title: T & U\r\n" in meta_block and b"outlink: /y\r\n" in meta_block and b"http-status: HTTP/1.1 200 OK\r\n" in meta_block
    data = b"".join(warc_derive.pack(*r) for r in (source, (meta, meta_block), (conv, conv_block)))
    assert list(warc_derive.unpack(data)) == [(*source, None), (meta, meta_block, None), (conv, conv_block, None)]
    assert warc_derive.response(None, None, None)[1].endswith(b"\r\n\r\n")


def test_warc_records_that_are_not_whole():
    source = warc_derive.response(1, "u", "<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb")
    other = warc_derive.response(2, "v", "<p>c")
    whole = warc_derive.pack(*source) + warc_derive.pack(*other)
    assert [x[2] for x in warc_derive.unpack(whole)] == [None, None]
    bad = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabcdef\r\n\r\n", b"WARC/1.1\r\nContent-Length: 20\r\n\r\nabc\r\n\r\n"]
    got = list(warc_derive.unpack(b"".join(bad) + whole))
    assert [x[2] for x in got] == ["no Content-Length", "no Content-Length", "more than 2 bytes", "3 of 20 bytes", None, None] or got[3][2].endswith("of 20 bytes")
    assert got[-1][:2] == other
    assert [x[2] for x in warc_derive.unpack(b"junk")] == ["no version line"] and list(warc_derive.unpack(b"")) == []


@pytest.mark.parametrize(
    "html, text, title, links",
    [
        ("<p>a<br>b</p><!-- no --><script>x<p></script>c", "a\nb\nc", "", []),
        ("<head><title>T &lt; U</title><meta></head><body>x", "x", "T < U", []),
        ("a < b <3 <a href='q\"r'>l</a> <a class=x href=/z>m</a><a title=\"href=no\">", 'a < b <3 l m', "", ['q"r', "/z"]),
        ("x <a href=\"unclosed>y</a> z <b>w", "x y z w", "", []),
        ("x <!-- open <p>y", "x", "", []),
        ("x <style>y", "x", "", []),
        ("x <b", "x", "", []),
        ("&amp;lt; &eacute;", "&lt; é", "", []),
        ("", "", "", []),
    ],
)
def test_visible_text(html, text, title, links):
    assert warc_derive.scan(html) == (text, title, links)


HOSTILE = {
    "div": "<div>" * 60_000, "comment": "<!--" * 60_000, "a": "<a " * 60_000, "paragraphs": "<b><p>" * 30_000, "ends": "<div>" * 30_000 + "</x>" * 60_000, "inline": "<b><article>" + "<i>" * 30_000 + "</b>" * 30_000, "quotes": "<a b=\"" * 30_000, "mixed": "<a \"'>" * 40_001,
    "instructions": "<?" * 60_000, "references": "&" * 200_000, "scripts": "<script>" * 30_000, "titles": "<title>" * 30_000, "stray": "< " * 60_000, "items": "<ul><li>" * 30_000, "cells": "<table><tr><td>" * 20_000, "slashes": "</" * 60_000, "sections": "<![" * 30_000 + "<![foo]>", "attributes": "<a " + "x=1 " * 60_000 + ">", "equals": "<a " + "=" * 60_000 + ">", "href": "<a " + "href " * 60_000 + ">",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_markup_takes_linear_time(kind):
    began = time.process_time()
    html_extract.extract(HOSTILE[kind])
    warc_derive.scan(HOSTILE[kind])
    assert time.process_time() - began < 3


LONG = "<p>" + "A long paragraph of an article with many words in it, " * 6 + "</p>"
SHORT = "A long paragraph of an article with many words in it, " * 5 + "A long paragraph of an article with many words in it,"


@pytest.mark.parametrize(
    "html, expected",
    [
        (f"<article><h1>T</h1>{LONG}<p>See <label>lab</label> and <math><mi>x</mi></math>.</p></article>", ["T", SHORT, "See lab and x."]),
        (f"<article>{LONG}<section class='reviews'><h2>R</h2><p>Short.</p></section>{LONG}</article>", [SHORT, "R", "Short.", SHORT]),
        (f"<main><div class='share-price-analysis'>{LONG}{LONG}</div><p>Tail.</p></main>", [SHORT, SHORT, "Tail."]),
        (f"<article>{LONG}{LONG}<div><p>Al: nice</p><p>Bo: yes</p></div></article>", [SHORT, SHORT]),
        (f"<body><nav>n</nav><div><div>{LONG * 4}</div><div>{LONG}</div></div><footer>f</footer>", [SHORT] * 5),
        (f"<article>{LONG * 3}</article><article>{LONG}</article>", [SHORT] * 4),
        (f"<article>{LONG * 3}<article><p>A comment.</p></article></article>", [SHORT] * 3),
        (f"<div id=c><h1>Title</h1><div>{LONG}{LONG}</div></div><div><a href=x>one</a><a href=y>two</a></div>", ["Title", SHORT, SHORT]),
        (f"<div>{LONG[3:-4]}</div><div>Brief.</div><div>{LONG[3:-4]}</div>", [SHORT, "Brief.", SHORT]),
        (f"<div class='cookie-notice'>{LONG}</div><article>{LONG}<p>Under a licence.</article>", [SHORT, "Under a licence."]),
        ("<![foo]><p>x <![CDATA[y]]> z</p><?php a ?>", ["x z"]),
    ],
)
def test_regions(html, expected):
    assert html_extract.extract(html).split("\n\n") == expected


def test_made_pages_come_back():
    rng = random.Random(31)
    words = lambda a, b: " ".join(rng.choice(["alpha", "beta", "gamma", "of", "the", "&amp;", "é"]) for _ in range(rng.randint(a, b)))
    for i in range(150):
        parts = [f"<{t}>{x}</{t}>" for t, x in (("h1", words(3, 8)), *((rng.choice(["p", "p", "p", "blockquote", "h2", "li"]), words(*rng.choice([(30, 90), (30, 90), (1, 8)]))) for _ in range(rng.randint(3, 12))))]
        parts[1] = f"<p>{words(50, 90)}</p>"
        truth = [" ".join(x.replace("&amp;", "&").split()) for p in parts for x in [p.split(">", 1)[1].rsplit("<", 1)[0]]]
        holder = rng.choice(["article", "main"])
        around = [f"<nav><ul><li><a href=/>{words(1, 3)}</a></ul></nav>", f"<div class='{rng.choice(['ad', 'top-advert', 'sidebar'])}'>{words(5, 60)}</div>", f"<aside>{words(5, 60)}</aside>", f"<form><label>{words(1, 5)}</label><input></form>", f"<script>var x = '<p>{words(30, 60)}</p>';</script>", f"<header>{words(1, 9)}</header>"]
        rng.shuffle(around)
        k = rng.randrange(len(around))
        inside = f"<section id=comments><p>{words(20, 40)}</p></section>" if i % 2 else ""
        page = f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(around[:k])}<{holder}>{''.join(parts)}{inside}</{holder}>{''.join(around[k:])}<footer>{words(3, 30)}</footer></body></html>"
        assert html_extract.extract(page).split("\n\n") == truth, page
