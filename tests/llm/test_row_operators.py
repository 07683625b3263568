"""Language, lines, chats, mixing, vectors, components and the pipeline against brute force on small tables."""

import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, common, flat_graph, language, line_dedup, mixing, vector_dedup
from tallyloom.llm.components import connected_components
from tallyloom.llm.ranges import bounds, range_of

RANDOM = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, row string, lines string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 1, "x", "y", "z") for i, t, lang, s in rows], DOCS)


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(RANDOM.randrange(80), RANDOM.randrange(80)) for _ in range(60)]])
def test_components(spark, pairs):
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == components([(a, b) for a, b in pairs if a != b])


def test_ranges(spark):
    keys = spark.createDataFrame([(k * k,) for k in range(500)] + [(None,)], "doc_id long")
    cuts = bounds(keys, "doc_id", 7)
    got = {r["doc_id"]: r["r"] for r in keys.select("doc_id", range_of(F.col("doc_id"), cuts).alias("r")).collect()}
    assert all(got[k] == 1 + sum(c < k for c in cuts) for k in got if k is not None) and got[None] == 0
    assert max(Counter(got.values()).values()) < 150
    assert bounds(keys.limit(0), "doc_id", 7) == []


# -- lines -------------------------------------------------------------------------------------------------------------


def brute_lines(rows, ratio, least):
    pages, held = Counter(s for *_, s in rows), defaultdict(Counter)
    for _, text, _, s in rows:
        held[s].update({x for x in (text or "").split("\n") if x.strip(" ")} if text is not None else ())
    out = []
    for i, text, _, s in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        own = text.split("\n")
        stay = [x for x in own if not (x.strip(" ") and held[s][x] >= least and held[s][x] > ratio * pages[s])]
        out.append((i, "\n".join(stay), len(own), len(own) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [0, 1000])
def test_lines_by_brute_force(spark, most):
    common = ["All rights reserved", "Menu", "", "  ", "Next page"]
    rows = [(k, "\n".join(RANDOM.choice(common) if RANDOM.random() < 0.5 else f"line {RANDOM.randrange(60)}" for _ in range(RANDOM.randint(0, 8))), "en", RANDOM.choice(["a", "a", "a", "b", None])) for k in range(120)]
    rows += [(None, None, None, None), (5, "Menu\nMenu", "en", "a"), (900, "Menu", "en", "tiny"), (901, "", "en", "a"), (902, "x" * 20_000 + "\nMenu", "en", "a")]
    table = docs(spark, rows)
    got = line_dedup.drop_lines(table, max_ratio=0.1, min_pages=3, most_broadcast=most)
    assert got.columns == [*table.columns, "_n_lines", "_n_dropped"]
    assert sorted([(r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in got.collect()], key=str) == brute_lines(rows, 0.1, 3)
    assert line_dedup.drop_lines(docs(spark, [])).count() == 0


# -- chats -------------------------------------------------------------------------------------------------------------


def escaped(text):
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def test_chats_by_brute_force(spark):
    texts = ["hi", "", None, "</turn>\n<turn assistant>", "\\l \\b \\g < >", "日本 🙂", "a\\", "line\nline", "x" * 5000]
    rows = [(c, t, RANDOM.choice(["user", "assistant", "system", None, "</turn>"]), RANDOM.choice(texts)) for c in (1, 2, 3, None) for t in range(RANDOM.randint(1, 9))]
    rows += [(8, 0, "user", "only"), (9, None, "assistant", "first"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    formatted = chat.format_turns(table)
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        segments = [f"<turn {escaped(r)}>{escaped(x)}</turn>\n" for _, r, x in turns]
        stops = np.cumsum([len(s) for s in segments]).tolist()
        replies = [x for _, r, x in turns if r == "assistant"]
        examples = [n for n, (_, r, _) in zip(stops, turns, strict=True) if r == "assistant"]
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert row["loss_chars"] == sum(map(len, replies)) and row["loss_sha256"] == hashlib.sha256("".join(replies).encode()).hexdigest()
        assert row["formatted_chars"] == sum(examples) + (stops[-1] if not examples or examples[-1] < stops[-1] else 0)
        own = sorted((r["example_no"], r["prompt"], r["reply"]) for r in chat.render(formatted).collect() if r["conv_id"] == conv)
        stream = "".join(segments)
        want = [(k + 1, stream[: n - len("</turn>\n") - len(escaped(x))], escaped(x)) for k, (n, x) in enumerate(zip(examples, replies, strict=True))]
        assert own == want
    assert chat.digest(chat.format_turns(table.limit(0))).count() == 0


def test_chat_sizes_are_those_of_the_written_examples(spark):
    turns = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"t<{t}>" * t) for c in (1, 2) for t in range(6 + c)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns)
    want = sorted(chat.digest(formatted).collect())
    assert sorted(chat.digest(formatted.withColumn("stop", F.lit(None).cast("long"))).collect()) == want and all(r["formatted_chars"] for r in want)


# -- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_brute_force(spark, seed):
    own = random.Random(seed)
    sizes = {s: own.choice([0, 1, 5, 50, 1000, 100_000]) * own.randint(1, 9) for s in [*"azbÀ", "日", None][: own.randint(1, 6)]}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r["source"] for r in got} == set(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
    assert sum(r["target"] for r in got) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets_and_agrees_with_its_plan(spark):
    rows = [(k, "w " * RANDOM.randint(1, 30), "en", RANDOM.choice(["a", "b", "b", "b", "c", None])) for k in range(900)]
    rows += [(2000, None, None, "a"), (2001, "", "en", "empty"), (2002, " \t\n", "en", "empty"), (7, "again and again", "en", "a")]
    table = docs(spark, rows)
    plan = mixing.plan_mix(table)
    first, again = (sorted([tuple(r) for r in plan.collect()], key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    taken, target = Counter(), {}
    for r in plan.collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((k, t) for k, t, *_ in rows if k != 7).get(r["doc_id"]) or "")) or r["doc_id"] == 7
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 31 + 0.02 * target[s]
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
    for s in target:
        assert abs(words[s] - target[s]) <= 31 + 0.02 * target[s]
    assert mixing.plan_mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


def test_mix_takes_repeated_rows_as_often_as_its_plan_says(spark):
    table = docs(spark, [(1, "one two", "en", "a")] * 5 + [(2, "three", "en", "b")] * 4)
    want = Counter()
    for r in mixing.plan_mix(table).collect():
        want[r["source"]] += r["target"]
    got = Counter(r["source"] for r in mixing.mix(table).collect())
    for source, n, size in (("a", 5, 2), ("b", 4, 1)):
        expected = want[source] / n / size
        assert abs(got[source] - expected) <= 1


# -- language ----------------------------------------------------------------------------------------------------------

WORDS = {"en": "the and with that from this have were their which", "de": "der und nicht eine werden schon über auch müssen einer", "fr": "les des dans être avec pour mais une étaient leur"}


def sentences(lang, n):
    return " ".join(RANDOM.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, sentences(lang, 40), lang, "s") for k in range(240) for lang in [list(WORDS)[k % 3]]]
    return language.fit(docs(spark, rows))


def test_text_model_on_held_out_texts(model):
    right = 0
    for _ in range(100):
        for lang in WORDS:
            _, evidence = model.evidence(sentences(lang, 6).encode())
            right += model.languages[int(np.argmax(model.posterior(evidence)))] == lang
    assert right >= 297


def test_documents_without_a_language_go_and_clean_ones_stay(spark, model):
    clean = [(k, sentences(lang, RANDOM.randint(3, 200)), lang, "s") for k, lang in enumerate([*WORDS] * 10)]
    junk = [(100, None, None, "s"), (101, "", "en", None), (102, "12 345 !!! ### 99", "en", "s"), (103, "xqzj vkwq zzxq qjxw wvkz qxqx jzkq vwxz kqjz xxqv" * 5, "en", "j"), (104, "日" * 3, None, "j")]
    table = docs(spark, clean + junk + [clean[0]])
    for most in (0, 1000):
        kept = language.keep_known(table, model, most_broadcast=most)
        assert kept.columns == table.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(30)]
    assert language.keep_known(docs(spark, []), model).count() == 0


def test_page_evidence_decides_where_the_text_does_not(spark, model):
    html = lambda lang, text: f'<!DOCTYPE html><html lang="{lang}"><head><script>the and with</script></head><body><p>{text}</p></body></html>'
    pages = [(k, f"http://www.site{k % 3}.example.{['com', 'de', 'fr'][k % 3]}/x", html(lang, sentences(lang, 30))) for k, lang in enumerate([*WORDS] * 30)]
    pages += [(900, "http://new.example.de/", html("de", "ok")), (901, "http://other.example.fr/", html("fr", "ok")), (902, None, None), (903, "not an address", "<p>" + sentences("en", 20))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in language.identify(language.from_pages(table, F.col("page_id")), model).collect()}
    assert (got[900]["lang"], got[901]["lang"], got[903]["lang"]) == ("de", "fr", "en")
    assert not got[902]["kept"] and got[903]["kept"]
    assert all(got[k]["lang"] == lang for k, lang in enumerate([*WORDS] * 30))


def brute_scores(rows, languages, weight, unit):
    """Scores by Bayes' rule, each document's own belief left out of every sum; rows are (host, domain, declared, suffix, n, evidence, belief)."""
    size, values = range(len(languages)), {k: len({r[k] for r in rows if r[k] is not None}) for k in (2, 3)}
    out = []
    for mine, row in enumerate(rows):
        others = [r for k, r in enumerate(rows) if k != mine]
        belief = lambda test: [sum(r[6][k] for r in others if test(r)) / unit for k in size]  # noqa: E731, B023
        smooth = lambda found, above: [(found[k] + weight * above[k]) / (sum(found) + weight) for k in size]
        every = belief(lambda r: True)
        prior = [(every[k] + 1) / (sum(every) + len(languages)) for k in size]
        for key in (1, 0):
            if row[key] is not None:
                prior = smooth(belief(lambda r: r[key] == row[key]), prior)  # noqa: B023
        score = [np.log(max(prior[k], 1e-9)) + row[5][k] for k in size]
        for key in (2, 3):
            if row[key] is not None:
                found = belief(lambda r: r[key] == row[key])  # noqa: B023
                score = [score[k] + np.log((found[k] + 1) / (every[k] + max(1, values[key]))) for k in size]
        out.append(score)
    return out


def test_scores_by_brute_force(spark):
    unit, languages, rows = language.UNIT, ["x", "y", "und"], []
    for k in range(60):
        belief = RANDOM.choices(range(1, 5), k=3)
        rows.append((RANDOM.choice(["a.b", "c.b", "d.e", None]), RANDOM.choice(["b", "e", None]), RANDOM.choice(["x", "y", "z", None]), RANDOM.choice(["q", "r", None]), k % 7, [RANDOM.uniform(-9, 0) for _ in languages], [b * unit // sum(belief) for b in belief]))
    rows += [rows[0], rows[0], ("only", "alone", "once", "here", 5, [-1.0, -2.0, -3.0], [unit, 0, 0])]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, host string, domain string, declared string, suffix string, n long, evidence array<double>, belief array<long>")
    got = {r["id"]: r for r in language.fuse(frame, languages, prior_weight=2.5).collect()}
    for k, want in enumerate(brute_scores(rows, languages, 2.5, unit)):
        assert got[k]["score"] == pytest.approx(want, rel=1e-9)
        assert got[k]["lang"] == languages[int(np.argmax(want))]
        assert got[k]["confidence"] == pytest.approx(np.exp(max(want)) / np.exp(want).sum())


def test_markup_in_one_pass():
    pattern = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    parts = [b"<!--", b"-->", b"<script", b"<script>", b"</script>", b"</SCRIPT  >", b"</scripty>", b"<style x>", b"</style>", b"<", b">", b"a", b" b ", b"<p>", b"<!-->", b"\n", b"<scripts>"]
    for _ in range(20_000):
        raw = b"".join(RANDOM.choice(parts) for _ in range(RANDOM.randint(0, 12)))
        assert language.visible(raw) == pattern.sub(b" ", raw)
    began = time.perf_counter()
    for part in (b"<!--", b"<script>", b"<style></styl", b"<!-- >"):
        language.visible(part * 400_000)
    assert time.perf_counter() - began < 20


def test_the_text_model_is_fitted_on_a_bounded_sample_that_repeated_rows_do_not_swell(spark):
    rows = [(k, sentences("en", 5), "en", "s") for k in range(400)] + [(None, "die gleiche Zeile", "de", "s")] * 300
    whole, part = language.fit(docs(spark, rows)), language.fit(docs(spark, rows), most_labelled=100)
    assert whole.languages == ["de", "en", "und"] and part.languages[-1] == "und"
    once = language.fit(docs(spark, rows[:401]))
    assert np.array_equal(once.table, whole.table)  # repeated rows count once
    assert language.fit(docs(spark, [])).languages == ["und"]


def test_lines_replace_columns_of_the_same_names(spark):
    table = docs(spark, [(k, "Menu\nown", "en", "a") for k in range(6)]).withColumn("_n_lines", F.lit("clash")).withColumn("_n_dropped", F.lit(None))
    got = line_dedup.drop_lines(table)
    assert got.columns == [c for c in table.columns if c[0] != "_"] + ["_n_lines", "_n_dropped"] and got.first()["_n_lines"] == 2
    assert line_dedup.drop_lines(table, counts=False).columns == table.columns


def test_hostile_pages_take_linear_time(spark):
    """10 MB each: html elements without an end, with one, a tag of blanks, and an address of one long label."""
    pages = ["<html " * 1_700_000, "<html>" * 1_700_000, "<html" + " " * 10_000_000 + "lang=de>", "<html lang" + " " * 10_000_000 + ">", "<html " + "lang " * 2_000_000 + "x=lang=fr>"]
    rows = [(k, "http://a.b/", html) for k, html in enumerate(pages)] + [(9, "http://" + "a" * 300_000 + "/", "<html lang=it>"), (10, "http://" + "." * 300_000, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(len(rows)).cache()
    frame.count()
    began = time.monotonic()
    got = {r["page_id"]: r["declared"] for r in language.from_pages(frame, F.col("page_id")).select("page_id", "declared", "domain", "suffix").collect()}
    assert time.monotonic() - began < 15 and got == {0: None, 1: None, 2: "de", 3: None, 4: "fr", 9: "it", 10: None}
    frame.unpersist()


def test_declared_language_of_several_elements(spark):
    cases = {"<html lang='en' xml:lang=DE>": "de", "<!-- <html> --><HTML class=a LANG = \"fr-CA\">": "fr", "<htmllang=en>": None, "<html lang=>en": None, "<html lang='9'><html lang=it>": "it", "": None}
    rows = [(k, u, html) for k, html in enumerate(cases) for u in ("http://x.y.co.uk/a",)]
    got = language.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), F.col("page_id")).orderBy("page_id").collect()
    assert [r["declared"] for r in got] == list(cases.values()) and {(r["domain"], r["suffix"]) for r in got} == {("co.uk", "uk")}
    hosts = {"http://localhost/": (None, "localhost"), "http://a..b/": (None, "b"), "http://b.c./": (None, None)}
    got = language.from_pages(spark.createDataFrame([(k, u, "") for k, u in enumerate(hosts)], "page_id long, url string, html string"), F.col("page_id")).orderBy("page_id").collect()
    assert [(r["domain"], r["suffix"]) for r in got if r["host"] is not None] == [v for r, v in zip(got, hosts.values(), strict=True) if r["host"] is not None]


def test_declared_language_is_found_wherever_the_html_element_stands(spark):
    late = "<!-- " + "licence " * 1000 + "-->" + " " * 5000 + "<html class=x lang='De-at'><p>Text</p></html>"
    pages = spark.createDataFrame([(1, "http://a.b.at/x", late), (2, "http://a.b.at/y", "<html><p>Text</p></html>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["declared"] for r in language.from_pages(pages, F.col("page_id")).collect()}
    assert got == {1: "de", 2: None}


# -- vectors -----------------------------------------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.98):
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = Counter(), []
    for x, a in enumerate(good):
        for b in good[:x]:
            u, w = np.array(rows[a][1], float), np.array(rows[b][1], float)
            u, w = u / np.abs(u).max(), w / np.abs(w).max()
            if rows[a][2] == rows[b][2] and len(u) == len(w) and u @ w / np.sqrt(u @ u) / np.sqrt(w @ w) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    root = components(pairs)
    least = defaultdict(list)
    for k in good:
        least[root.get(k, k)].append(rows[k][0])
    return sorted([(rows[k][0], links[k], min(least[root.get(k, k)]) if k in good else rows[k][0]) for k in range(len(rows))], key=str)


@pytest.mark.parametrize(("shard", "children"), [(1000, 64), (20, 2)])
def test_vectors_by_brute_force(spark, shard, children, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHILDREN", children)
    own, rows = np.random.default_rng(3), []
    for label in (1, 2):
        for spread in (0.0, 0.01, 0.025, 0.05, 0.3):
            centre = own.normal(size=16)
            rows += [(len(rows) + k, (centre + spread * own.normal(size=16) * np.linalg.norm(centre) / 4).astype(np.float32).tolist(), label) for k in range(25)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, rows[0][1], None), (905, rows[0][1], 2), (906, [], 1), (907, rows[0][1][:8], 1), (None, rows[0][1], 1), (0, rows[0][1], 1), (908, [3e30 * x for x in rows[0][1]], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = vector_dedup.near_vectors(table, shard=shard).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert vector_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1000, 40])
def test_links_that_every_search_misses_are_found_by_comparison(spark, shard, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 30, raising=False)
    monkeypatch.setattr(vector_dedup, "_explore", lambda members, heads, threshold, beam: spark.createDataFrame([], vector_dedup.FOUND))
    own = np.random.default_rng(5)
    rows = [(6 * k + n, (own.normal(size=16) * 0.1 + centre).astype(np.float32).tolist(), k % 2) for k, centre in enumerate(own.normal(size=(40, 16))) for n in range(6)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=shard).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == brute_vectors(rows)


def test_a_large_group_of_near_copies_does_not_hide_lost_links(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "_explore", lambda members, heads, threshold, beam: spark.createDataFrame([], vector_dedup.FOUND))
    own = np.random.default_rng(6)
    near = lambda centre, spread: (centre + spread * own.normal(size=16)).astype(np.float32).tolist()
    large, pairs = own.normal(size=16), own.normal(size=(20, 16))
    rows = [(k, near(large, 0.01), 1) for k in range(300)] + [(300 + 2 * k + n, near(c, 0.1), 2 if k < 2 else 1) for k, c in enumerate(pairs) for n in range(2)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == brute_vectors(rows)


def test_shards_stay_bounded_whatever_the_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHILDREN", 4)
    monkeypatch.setattr(vector_dedup, "DEEPEST", 3)
    own = np.random.default_rng(7)
    rows = [(k, own.normal(size=8).tolist(), "large") for k in range(1500)] + [(2000 + k, [float(k + 1)] * 8, "line") for k in range(300)] + [(3000 + k, own.normal(size=8).tolist(), f"l{k // 2}") for k in range(600)]
    nodes = spark.createDataFrame(rows, "node long, vec array<double>, grp string")
    placed = vector_dedup.shards(nodes, 25, 2).collect()
    sizes, homes = Counter(r["cell"] for r in placed), Counter(r["node"] for r in placed if r["home"])
    assert max(sizes.values()) <= 50 and set(homes.values()) == {1} and len(homes) == len(rows)
    assert all(r["cell"].endswith("|" + r["grp"]) for r in placed)


def test_vectors_of_many_labels_and_of_any_scale(spark):
    own, rows = np.random.default_rng(10), []
    for label in range(3000):
        centre = own.normal(size=4)
        rows += [(len(rows) + k, (scale * (centre + own.choice([0.02, 0.3]) * own.normal(size=4))).tolist(), f"{label}/|") for k, scale in enumerate([1.0, 1e200][: 1 + label % 2])]
    rows += [(9000, [1e200, 0.0], "far"), (9001, [0.0, 1e200], "far"), (9002, [1e-200, 0.0], "far"), (9003, [5e-324, 0.0], "far"), (9004, [1e-200, 1e-200], "far")]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    want = []
    for label in {r[2] for r in rows}:
        want += brute_vectors([r for r in rows if r[2] == label])
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got]) == sorted(want)


def test_a_dense_label_over_many_shards_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LEAST_RECALL", 0.0)
    own = np.random.default_rng(12)
    centre = own.normal(size=16)
    rows = [(k, (centre + own.choice([0.05, 0.12, 0.2]) * own.normal(size=16)).tolist(), 1) for k in range(700)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=60).collect()
    want = {i: (n, c) for i, n, c in brute_vectors(rows)}
    found, true = sum(r["n_links"] for r in got), sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] and r["recall"] >= 0.98 for r in got) and found >= 0.98 * true
    assert [r["component_id"] for r in got].count(0) >= 0.98 * [c for _, c in want.values()].count(0)


@pytest.mark.parametrize(("n", "shard"), [(3000, 250), (6000, 2000)])
def test_no_link_is_lost_along_a_circle(spark, n, shard):
    """One dense label that goes round through many shards: every count and the component are those of brute force."""
    plane = np.linalg.qr(np.random.default_rng(1).normal(size=(32, 2)))[0]
    at = np.random.default_rng(2).uniform(0, 2 * np.pi, n)
    vectors = np.stack([np.cos(at), np.sin(at)], axis=1) @ plane.T
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {k: int((unit[k] @ unit.T >= 0.98).sum()) - 1 for k in range(n)}
    rows = [(k, v, 1) for k, v in enumerate(vectors.tolist())]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), shard=shard).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want and {r["component_id"] for r in got} == {0} and all(r["recall"] == 1 for r in got)


def test_steps_are_deleted_but_the_last(spark, tmp_path, monkeypatch):
    own = np.random.default_rng(4)
    monkeypatch.setattr(common, "scratch_path", lambda session, name: f"{tmp_path}/{name}-{own.integers(1 << 60)}")
    rows = [(k, own.normal(size=8).tolist(), 1) for k in range(60)] * 2
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert len(list(tmp_path.iterdir())) == 1 and got.count() == 120 and {r["n_links"] for r in got.collect()} == {1}


def test_search_finds_what_is_in_range():
    own = np.random.default_rng(8)
    vectors = own.normal(size=(700, 24))
    vectors[100:300] = vectors[0] + 0.05 * vectors[100:300]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    edges = flat_graph.build(vectors)
    assert flat_graph.reached(edges, flat_graph.medoid(vectors)).all()
    starts = np.stack([np.full(700, flat_graph.medoid(vectors)), np.full(700, -1)], axis=1)
    rows, nodes, value = flat_graph.walk(vectors, edges, starts, vectors, lambda rows, nodes: 0.98)
    assert np.allclose(value, (vectors[rows] * vectors[nodes]).sum(axis=1))
    true = {(a, b) for a, b in zip(*np.nonzero(vectors @ vectors.T >= 0.98), strict=True)}
    assert len(true & set(zip(rows.tolist(), nodes.tolist(), strict=True))) >= 0.98 * len(true)


def test_balls_hold_only_vectors_that_are_near_each_other():
    own = np.random.default_rng(9)
    vectors = own.normal(size=(1, 8)) + 0.08 * own.normal(size=(600, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    least = float(np.cos(np.arccos(0.98) / 2))
    led = flat_graph.leaders(vectors, least)
    for leader in np.unique(led):
        members = vectors[led == leader]
        assert led[leader] == leader and (members @ members.T).min() >= 0.98 - 1e-9


def test_operators_leave_the_session_as_it_was(spark):
    held = lambda: {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")}
    from tallyloom.llm import queries

    before = held()
    for name, run in queries.QUERIES.items():
        run(spark, "/root/testdata/sf0.001")
        assert held() == before, name


def test_a_dense_shard_is_searched_in_bounded_memory():
    n, random = 1000, np.random.default_rng(3)
    vectors = vector_dedup.unit(random.normal(size=(1, 16)) + 0.01 * random.normal(size=(n, 16)))
    hub = [np.array([j for j in range(n) if j != i]) if i % 10 == 0 else np.array([i - i % 10]) for i in range(n)]
    columns = {"cell": ["c"] * n, "node": np.arange(n), "vec": pa.array(list(vectors)), "weight": np.ones(n, np.int64), "reach": np.zeros(n), "home": np.ones(n, bool), "asked": np.ones(n, bool)}
    table = pa.table({**columns, "cells": [["c", f"d{k % 100}"] for k in range(n)], "near": pa.array(hub), "guest": np.zeros(n, bool), "entry": pa.nulls(n, pa.int64())})
    tracemalloc.start()
    found = list(vector_dedup._searcher(0.98, flat_graph.BEAM)(iter(table.to_batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = pa.Table.from_batches(found).to_pandas()
    counts = rows[rows["kind"] == vector_dedup.COUNT].set_index("a")["n"]
    assert len(counts) == n and (counts == n - 1).all()
    stars = rows[rows["kind"] == vector_dedup.STAR]
    assert sorted(stars["a"]) == list(range(1, n)) and (stars["b"] == 0).all()
    visits = rows[rows["kind"] == vector_dedup.VISIT]
    assert set(zip(visits["a"], visits["cell"])) == {(a, f"d{k}") for a in range(n) for k in range(100) if k != a % 100}
    assert peak < 400 << 20, peak
