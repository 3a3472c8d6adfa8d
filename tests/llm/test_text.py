"""Decontamination, licenses and pages on small known cases."""

import itertools
import random

import numpy as np
import pytest

from cloudstrata.llm import decontaminate, html_text, licenses

ITEM = "A train leaves Boston at 3 and travels 120 km toward Chicago while another train leaves Chicago and covers 120 km in 3 hours; when do they meet?"
OTHER = "A train leaves Paris at 7 and travels 450 km toward Lyon while another train leaves Lyon and covers 450 km in 7 hours; when do they meet?"
WRONG = "A train leaves Paris at 7 and travels 450 km toward Lyon while another train leaves Nice and covers 81 km in 2 hours; when do they meet?"


def filler(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(["stone", "river", "holds", "under", "slow", "green", "light", "moves"]) for _ in range(n)) + "."


def test_contamination(spark, docs_of):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "1 2 3 4 5 6 7 8 9"), (5, "Short question here"), (None, filler(9))], "item_id long, text string")
    texts = [filler(1) + " " + ITEM + " " + filler(2), filler(3) + " " + OTHER, filler(4) + " " + WRONG, filler(5), None, "", ITEM, "9 8 7 6 5 4 3 2 1 0", "so. Short question here now", "x " * 50_000 + ITEM]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contamination(docs_of(texts), items).collect()}
    assert {k for k in got if k[1] == 1} == {(0, 1), (1, 1), (6, 1), (9, 1)}
    assert (8, 5) in got and got[0, 1]["slots"] > 0  # an item shorter than a window is found before more words of its sentence, too
    kept = decontaminate.drop_contaminated(docs_of(texts), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 7]
    assert decontaminate.find_contamination(docs_of(texts), items.limit(0)).count() == 0
    assert decontaminate.find_contamination(docs_of([]), items).count() == 0


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_patience():
    r = random.Random(2)
    for _ in range(300):
        a, b = [[r.randrange(12) for _ in range(r.randint(0, 20))] for _ in range(2)]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= common(a, b)
        assert all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:], strict=False))
    for n in range(1, 30):  # words that stand once: the longest common subsequence itself
        a, b = r.sample(range(60), n), r.sample(range(60), n)
        assert len(licenses.patience(a, b)) == common(a, b)


def place_words(text):
    return licenses.words_of(text)


def test_places_of_licenses(docs_of):
    """Whole texts by name, with places and coverage, where foreign words of any number stand between their parts."""
    for name, text in licenses.NOTICES.items():
        words = len(place_words(text))
        for between in (0, 40, 120, 5000) if words >= 60 else (0,):
            parts = text.split()
            half = len(parts) // 2
            page = filler(3, 30) + "\n" + " ".join(parts[:half]) + ("\n" + filler(4, between) + "\n" if between else " ") + " ".join(parts[half:]) + "\n" + filler(5, 30)
            rows = [r for r in licenses.scan_licenses(docs_of([page])).collect()] if between in (0, 120) else [licenses_row(r) for r in licenses.Scanner(licenses.NOTICES, licenses.COVERAGE).scan(page)]
            mine = [r for r in rows if r["license"] == name]
            assert len(mine) == 1, (name, between, rows)
            r = mine[0]
            assert {x["license"].split("-")[0] for x in rows} <= {name.split("-")[0], *(["BSD"] if name.startswith("BSD") else [])}, (name, rows)
            before = len(place_words(filler(3, 30)))
            assert r["coverage"] >= 0.95 and before <= r["first_word"] <= before + 2 and abs(r["last_word"] - (before + words + between - 1)) <= 2, (name, between, r)


def licenses_row(r):
    return dict(zip(("license", "coverage", "matched", "first_word", "last_word"), r, strict=True))


def test_coverage_against_common_subsequence():
    """No place claims more than a longest common subsequence, and damaged copies reach nearly that."""
    r = random.Random(12)
    scanner = licenses.Scanner(licenses.NOTICES, licenses.COVERAGE)
    for name in ("MIT-full", "GPL-header", "Zlib-full", "ISC-full"):
        text = place_words(licenses.NOTICES[name])
        for _ in range(12):
            damaged = [w for w in text if r.random() > 0.08]
            for _ in range(6):
                damaged.insert(r.randrange(len(damaged)), r.choice(["foo", "bar", "the", "software"]))
            found = [p for p in map(licenses_row, scanner.scan(" ".join(damaged))) if p["license"] == name]
            best = common(damaged, text)
            assert len(found) == 1 and best >= found[0]["matched"] >= 0.93 * best and found[0]["coverage"] == found[0]["matched"] / len(text)


def test_fragments_of_one_license_again(docs_of):
    parts = licenses.NOTICES["MIT-full"].split()
    one, two, three = (" ".join(parts[k * len(parts) // 3 : (k + 1) * len(parts) // 3]) for k in range(3))
    texts = [f"{one} {filler(1, 300)} {two} {filler(2, 300)} {three} {filler(3, 300)} {one} {filler(4, 300)} {two} {filler(5, 300)} {three}", f"{one} {filler(6, 300)} {one} {filler(6, 300)} {one}", f"{three} {filler(7, 300)} {one}"]
    rows = licenses.scan_licenses(docs_of(texts)).collect()
    assert [r["doc_id"] for r in rows if r["license"] == "MIT-full"] == [0, 0]
    scanner = licenses.Scanner(licenses.NOTICES, licenses.COVERAGE)
    assert len(scanner.scan((licenses.NOTICES["MIT-full"] + " " + filler(8, 500) + " ") * 60)) == 60


def test_licenses(docs_of):
    mit, gpl = licenses.NOTICES["MIT-text"], "This work is licensed under the GNU General Public License, version 2."
    texts = [filler(1) + "\n" + mit + "\n" + filler(2), gpl + "\n" + filler(3) + "\n" + gpl, filler(4), None, "", "Licensed under the Apache License, Version 2.0.", "the license of the software is under the version", mit.replace("free of charge", "at no cost").upper()]
    rows = licenses.scan_licenses(docs_of(texts)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [(0, "MIT-text"), (1, "GPL"), (1, "GPL"), (5, "Apache-2.0"), (7, "MIT-text")]
    assert all(licenses.COVERAGE <= r["coverage"] <= 1 for r in rows)
    assert licenses.scan_licenses(docs_of([])).count() == 0


def uncontained(places, family):
    return [p for p in places if not any(q[0] != p[0] and family[q[0]] == family[p[0]] and q[2] > p[2] and q[3] <= p[3] and p[4] <= q[4] for q in places)]


def test_contained_places_at_any_number():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.COVERAGE)
    for times in (3, 99, 100, 101, 260):  # each whole text holds a part that is a license text, too
        found = scanner.scan((licenses.NOTICES["MIT-full"] + " " + filler(8, 40) + " ") * times)
        assert [f[0] for f in found] == ["MIT-full"] * times
    r = random.Random(6)
    for _ in range(300):
        family = [r.randrange(2) for _ in range(5)]
        places = []
        for _ in range(r.randrange(14)):
            begin = r.randrange(8)
            places.append((r.randrange(5), 1.0, r.randrange(6), begin, begin + r.randrange(6)))
        assert licenses._uncontained(places, family) == uncontained(places, family)


@pytest.fixture(scope="module")
def field():
    return html_text.field(400, 3)


def test_made_pages(field):
    r, right, n = random.Random(77), 0, 0
    for _ in range(120):
        blocks = html_text.blocks_of(html_text.PageMaker(r).page(), "data-main")
        if blocks:
            s = field.viterbi(html_text.features(blocks), np.array([len(blocks)]))
            right += int((s == np.array([b[3] for b in blocks])).sum())
            n += len(blocks)
    assert right > 0.95 * n


def test_pages(spark, field):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- x -->'
        '<div class="ad">Buy this thing now, it is cheap.</div><article><h1>A title &amp; more</h1><p><b>First  words,\n of it.<br><p>Second&nbsp;paragraph has some more words in it.</p></article>'
        "<footer>&copy; 2024 &middot; all rights</footer>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "v", "<p"), (1, "u", page), (4, "w", "<b>" * 2000 + "x" * 100_000)]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model=field).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    want = "A title & more First words, of it. Second paragraph has some more words in it."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]


def test_tokenizer_is_tolerant():
    cases = {
        '<p>Price <span aria-hidden="true">$5 only</span> today</p>': ["Price $5 only today"], "<script src=/a/b/>var leaked = 1;</script>x": ["x"], "<p>a<style/>b{}</style>c</p>": ["ac"],
        "<iframe src='/x' />no</iframe>y": ["y"], "<p>a<svg/>b</p>": ["ab"], "<p>a<svg viewBox=/0/>b</svg>c</p>": ["ac"], "<title/>t</title>u": ["u"], "<div class=/a/>m</div>n": ["m", "n"], "<select/><option>o</select>p": ["p"],
    }
    cases |= {"a < b": ["a < b"], "a<b": ["a"], "<p>a<p>b": ["a", "b"], "<div>x<script>y</div>": ["x"], "<a title='>'>z</a>": ["z"], "<p hidden>q</p>r": ["r"], "x &lt; y &#233;": ["x < y é"], "<td>1<td>2": ["1", "2"]}
    for page, want in cases.items():
        assert [b[0] for b in html_text.blocks_of(page)] == want, page


def pairs_of(spark, docs, items):
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs, frame).collect()}


def test_short_items_in_longer_texts(spark, docs_of):
    items = ["What is the capital of France?", "Alice Mary Jones met Robert James Brown near old town.", "Name the largest ocean"]
    around = filler(1) + " {} " + filler(2)
    texts = [around.format(t) for t in (items[0], 'then asked "What is the capital of France?"', "What is the capital of France when it rains?", items[1], "Alice", "What is 7?")]
    texts += ["What is the capital of Spain?", around.format("Name the largest ocean\n"), "name the largest ocean", "What is the capital of France?"]
    assert pairs_of(spark, docs_of(texts), items) == {(0, 0), (1, 0), (2, 0), (3, 1), (6, 0), (7, 2), (8, 2), (9, 0)}


def test_short_items_within_sentences(spark, docs_of):
    """With three plain words or more an item is found before other words of its sentence; with fewer only where a sentence ends, or verbatim."""
    items = ["name the largest ocean", "over there", "Anna 7 12", "Is 91 prime?"]
    around = filler(1) + " {} " + filler(2)
    texts = ["please name the largest ocean of the world now", "we go over there now and then", "we go over there.", "we saw Anna 7 12 in the list", "we saw Berta 8 13 in the list", "they ask is 91 prime or not", "they ask is 97 prime or not", "name the deepest ocean of the world"]
    assert pairs_of(spark, docs_of([around.format(t) for t in texts]), items) == {(0, 0), (2, 1), (3, 2), (5, 3)}


def test_items_of_placeholders(spark, docs_of):
    items = ["12 + 30 = 42, 17 + 5 = 22, 8 + 9 = 17, 40 + 2 = 42", "Anna, Ben, Carl, Dora, Emil, Fritz, Gustav, Hanna, Ida", "On 3 May 1999 Smith paid 20 dollars, on 4 June 2001 Jones paid 30 dollars, on 5 July 2003 Brown paid 40 euros"]
    around = filler(1) + " {}. " + filler(2)
    texts = [around.format(t) for t in (items[0], "we met " + items[1], items[2], "12 + 31 = 43, 18 + 5 = 23, 9 + 9 = 18, 41 + 2 = 43", "Anna, Ben, Carl and Dora", "we met Anna Smith", "Anna Smith")]
    assert pairs_of(spark, docs_of(texts), items) == {(0, 0), (1, 1), (2, 2)}


def test_copy_beside_variants(spark, docs_of):
    item = "A farmer sells 7 baskets of red apples at the old market every single morning before the rain starts to fall"
    short, wild = "How many eggs are in 7 boxes?", "A farmer sells 7 baskets of red apples for 7 coins at the old market with 7 children before the rain"
    nine, eight = item.replace("7", "9"), item.replace("7", "8")
    texts = [" ".join([item + ".", filler(1), nine + ".", filler(2), nine + "."]), " ".join([short, short.replace("7", "9"), short.replace("7", "8")]), f"{eight}. {nine}. {item}."]
    texts += [filler(3) + " " + wild.replace("7", "4", 1).replace("7", "5", 1).replace("7", "6", 1)]
    assert pairs_of(spark, docs_of(texts), [item, short, wild]) == {(0, 0), (1, 1), (2, 0)}


def test_rows_are_judged_by_their_text(spark, docs_of):
    """A null or repeated id doesn't make one document of several; very long texts are whole; an item may be long, too."""
    items = spark.createDataFrame([(1, ITEM), (2, " ".join(f"word{k}x holds" for k in range(3000)))], "item_id long, text string")
    half = len(ITEM) // 2
    texts = [ITEM, filler(1), filler(2), filler(3), ITEM[:half], ITEM[half:], ITEM, ITEM, "y " * 200_000 + ITEM, " ".join(f"word{k}x holds" for k in range(3000))]
    docs = docs_of(texts, [None, None, None, 7, 8, 8, 7, 9, 10, 11])
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, filler(1)), (0, filler(2)), (7, filler(3)), (8, ITEM[:half]), (8, ITEM[half:])])
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs, items).collect()]
    assert sorted(found, key=str) == sorted([(None, 1), (7, 1), (9, 1), (10, 1), (11, 2)], key=str)


def plain_windows(tokens, sizes, item):
    """Place, size, whether what is written counts, and the tuple that has to be equal, of each window; as the module's docstring says."""
    code, written, kind, _, stops, _ = (t.tolist() if isinstance(t, np.ndarray) else t for t in tokens)
    n = len(code)
    whole = min(8, n)
    for size in sorted({whole} | {k for k in sizes if k < whole}) if n else ():
        for at in range(n - size + 1):
            slots = sum(k != decontaminate.WORD for k in kind[at : at + size])
            good, says = slots <= (4 if size == 8 else size // 2), slots == 0 or size - slots >= 3
            if size < whole:
                exact = not (good and says)
                if not stops[at + size - 1] and (size if exact else size - slots) < 3:
                    continue
                modes = [exact]
            else:
                modes = [False] * good + [True] * (not good or item and size < 8 and not says)
            for exact in modes:
                yield at, size, exact, tuple((written if exact else code)[at : at + size])


def brute_contamination(docs, items):
    canonical = decontaminate.Canonical()
    index, places, sizes = {}, {}, set()
    for i, text in items.items():
        rows = []
        tokens = canonical.tokens(text)
        rows += [(w, canonical.slots(w[0], w[1], tokens)) for w in plain_windows(tokens, (), True)]
        if len(tokens[0]) and tokens[2][0] == decontaminate.WORD and text.split()[0][:1].isupper():
            *parts, words = canonical.tokens("a " + text)
            if len(parts[0]) > 1 and parts[2][1] == decontaminate.NAME:
                tokens = (*(p[1:] for p in parts), words)
                rows += [(w, canonical.slots(w[0], w[1], tokens)) for w in plain_windows(tokens, (), True) if w[0] == 0]
        for (at, size, exact, key), slots in rows:
            index.setdefault((exact, key), []).append((i, at, slots))
            sizes |= {size} if size < 8 else set()
        places[i] = len({w[0] for w, _ in rows}), len({w[0] for w, _ in rows if not w[2]})
    found = set()
    for d, text in docs.items():
        tokens, met = canonical.tokens(text), {}
        for at, size, exact, key in plain_windows(tokens, sizes, False):
            for i, item_at, slots in index.get((exact, key), ()):
                windows = places[i][0]
                shift, cell = at - item_at, min(8, windows)
                for place in ((0, 0), (1, shift), (2, shift // cell), (3, (shift + cell // 2) // cell)):
                    met.setdefault((i, place), []).append((item_at, exact, slots, canonical.slots(at, size, tokens)))
        for (i, _), matches in met.items():
            windows, templates = places[i]
            every, plain = len({m[0] for m in matches}), len({m[0] for m in matches if not m[1]})
            covered, out_of = (every, windows) if every * max(templates, 1) >= plain * windows else (plain, templates)
            fills = [f for m in matches for f in itertools.zip_longest(m[2], m[3])]
            times = {f: fills.count(f) for f in set(fills)}
            same = sum(n for (a, b), n in times.items() if n == max(v for (x, _), v in times.items() if x == a) and n == max(v for (_, y), v in times.items() if y == b))
            if covered >= 0.6 * out_of and (not fills or same >= 0.8 * len(fills)):
                found.add((d, i))
    return found


def test_against_brute_force(spark, docs_of):
    """Whole tables of documents and benchmark, with items of three tokens, of numbers alone and of placeholders among words, verbatim and with other parameters."""
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    more = ["Name three oceans.", "7 + 12 = 19, 8 + 30 = 38, 40 - 2 = 38", "Ann has 5 apples and Bob has 9 pears; how many fruits have Ann and Bob?", ITEM, "Paris Rome Oslo Bern", "Is 91 prime?", "List 4 old towns on the 3 rivers of Spain now"]
    variants = [more[2].replace("5", "8").replace("Bob", "Eve"), more[2].replace("5", "8", 1).replace("Bob", "Eve", 1), OTHER, WRONG, "Is 97 prime?", more[6].replace("4", "6").replace("Spain", "Peru"), "name three rivers."]
    r, k = random.Random(4), 10**6
    for text in [*more, *variants]:
        for form in ("{}", filler(1) + " {} " + filler(2), filler(3) + " so {} and on\n", "{} {}"):
            docs[k] = form.replace("{}", text)
            k += 1
    for base in list(items.values())[:20]:
        words = base.split()
        words[r.randrange(len(words))] = str(r.randrange(99))
        docs[k] = filler(k) + " " + " ".join(words) + " " + filler(k + 1)
        k += 1
    items |= {10**6 + j: t for j, t in enumerate(more)}
    frame = spark.createDataFrame([*items.items()], "item_id long, text string")
    found = decontaminate.find_contamination(docs_of([*docs.values()], [*docs]), frame).collect()
    want = brute_contamination(docs, items)
    assert {(x["doc_id"], x["item_id"]) for x in found} == want and len(found) == len(want) > 40
