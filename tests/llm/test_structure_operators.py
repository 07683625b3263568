"""Conversation repair, vector codes and WARC archives against brute force on small tables."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import conversation_repair, vector_codes, warc

RANDOM = random.Random(29)
TURNS = "conv_id long, turn long, role string, text string, place int, fault string, audit string, copy int, lot int"


# -- conversation repair -----------------------------------------------------------------------------------------------


def proper(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def brute_solve(signature, most_inserted=3):
    """All edits of each row, and inserted roles in every gap up to a total."""
    found = []
    n = len(signature)
    for edits in itertools.product("KRD", repeat=n):
        if any(x == "x" and e != "D" for x, e in zip(signature, edits, strict=True)):
            continue
        cost = sum((0 if e == "K" else 1 if e == "R" else 2) + (5 if e != "D" and x.isupper() else 0) for x, e in zip(signature, edits, strict=True))
        for total in range(most_inserted + 1):
            for gaps in itertools.combinations_with_replacement(range(n + 1), total):
                held = Counter(gaps)
                audit, slots = "", []
                for k in range(n + 1):
                    audit += "I" * held[k]
                    slots += ["ua"] * held[k]
                    if k < n:
                        audit += edits[k]
                        slots += [signature[k].lower()] if edits[k] == "K" else ["ua"] if edits[k] == "R" else []
                if any(proper("".join(x)) for x in itertools.product(*slots)):
                    found.append((cost + 5 * total, audit))
    return min(found)


def test_solve_by_brute_force():
    for n in range(4):
        for signature in itertools.product("suaoSUAx", repeat=n):
            if n < 3 or RANDOM.random() < 0.15:
                assert conversation_repair.solve("".join(signature)) == brute_solve("".join(signature)), signature


def test_solve_of_a_long_signature():
    cost, audit = conversation_repair.solve("s" + "ua" * 20_000 + "x" + "U")
    assert cost == 2 + 2 and audit == "K" * 40_001 + "DD"


def brute_repair(turns):
    rows = defaultdict(list)
    every = {t[0] for t in turns}
    blanks = " \t\n\x0b\x0c\r"
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        rows[conv] += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    out = []
    for conv in every:
        own = sorted(rows[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, letters, illegal = Counter(), set(), "", 0
        for k, (_, role, text) in enumerate(own):
            whole = text.rstrip(blanks)
            fault = "blank" if not whole else "duplicate" if (role, text) in seen else "truncated" if whole[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            illegal += k > 0 and own[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = conversation_repair.solve(letters)
        kept, at, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else own[at][1:]
            at += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            kept.append(f"{role}:{text}")
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def chats():
    texts = ["Yes.", "No!", "no end", "", "  \t", None, "Why?\n\n", "é. ", "long " * 20_000 + "."]
    turns = [(c, t, RANDOM.choice(["user", "assistant", "system", "user", "assistant", None, "tool"]), RANDOM.choice(texts[:8]) if RANDOM.random() < 0.4 else f"Say {t}.") for c in range(150) for t in range(RANDOM.randint(0, 9))]
    turns += [(c, None, "user", "Hm.") for c in (3, 3, 900)] + [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, None, None, None), (5, -4, "user", texts[8]), (5, 400, "assistant", texts[8])]
    return turns + [(7, 3, "user", "again.")] * 4 + [(950, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(9000)]


def test_repair_by_brute_force(spark):
    turns = chats()
    table = spark.createDataFrame([(*t, 9, "x", "y", 1, 2) for t in turns], TURNS)
    got = conversation_repair.repair(conversation_repair.damage(table), every=table)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repair(turns)


def test_repaired_rows_are_proper(spark):
    table = spark.createDataFrame([(*t, 9, "x", "y", 1, 2) for t in chats() if t[0] != 950], TURNS)
    placed = conversation_repair.place(table)
    audited = conversation_repair.audits(conversation_repair.signatures(placed))
    rows = defaultdict(list)
    for r in conversation_repair.repaired(placed, audited).collect():
        rows[r["conv_id"]].append((r["place"], r["edit"], r["role"], r["text"]))
    audit = {r["conv_id"]: r["audit"] for r in audited.collect()}
    for conv, own in rows.items():
        own.sort()
        assert [p for p, *_ in own] == list(range(1, len(own) + 1)) and proper("".join(r[:1] for *_, r, _ in own))
        assert "".join(e for _, e, *_ in own) == audit[conv].replace("D", "")
        assert all(e != "I" or t == "" for _, e, _, t in own)
    assert {c for c, a in audit.items() if set(a) - {"D"}} == set(rows)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(conversation_repair.damage(empty), every=empty).collect() == []
    assert conversation_repair.repair(empty).collect() == []


# -- vector codes ------------------------------------------------------------------------------------------------------


def brute_codes(rows, entries=256, rounds=4):
    kept = [(i, [int((1024 * x) // 1) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and x - x == 0 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    cuts = list(itertools.accumulate([width // 4 + (k < width % 4) for k in range(4)], initial=0))
    cut = lambda v, p: v[cuts[p] : cuts[p + 1]]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((away(part, b), e) for e, b in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else b for e, b in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        best = [near(cut(v, p), books[p]) for p in range(4)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = Counter()
    for *_, label, _, error in ((r[0], r[1], r[2], r[3]) for r in out):
        sums[label] += error
    return [(i, label, code, error, sums[label]) for i, label, code, error in out], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, row int, code string, part string, pos int"


def vectors(width, n=120):
    base = [[RANDOM.choice([-0.5, -0.251, 0.0, 0.13, 0.9]) for _ in range(width)] for _ in range(25)]
    rows = [(k, [float(x) for x in RANDOM.choice(base)], RANDOM.choice([0, 0, 1, None])) for k in range(n)]
    rows += [(n + k, list(base[0]), 0) for k in range(60)]  # a third are copies
    bad = [(900, None, 1), (901, [float("nan")] * width, 1), (902, [float("inf")] * width, 1), (903, [None] * width, 1)]
    return [*rows, *bad, (None, list(base[1]), 1), (5, list(base[2]), 1), (5, list(base[2]), 1)]


@pytest.mark.parametrize(("width", "entries", "most"), [(8, 256, 10), (8, 7, 0), (10, 5, 10), (2, 3, 10)])
def test_codes_by_brute_force(spark, width, entries, most):
    rows = [(i, None if v is None else [None if x is None else float(spark_float(x)) for x in v], label) for i, v, label in vectors(width)]
    table = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], VECTORS)
    got, books = vector_codes.compress(table, entries=entries, most_labels=most)
    want, digest = brute_codes(rows, entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str) and books.sha256() == digest
    code = next(c for i, _, c, *_ in want if i == 0)
    assert len(books.decode(code)) == width


def spark_float(x):
    import numpy as np

    return np.float32(x)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS))[0].collect() == []
    mixed = spark.createDataFrame([(1, [0.5] * 4, 1, 1, "", "", 1), (2, [0.5] * 3, 1, 1, "", "", 1), (3, [], None, 1, "", "", 1)], VECTORS)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(mixed)[0].collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, None)}
    with pytest.raises(ValueError, match="magnitude"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1, 1, "", "", 1)], VECTORS))


def test_nearest_is_exact_for_large_integers():
    import numpy as np

    points = np.array([[(1 << 27) - 1, -(1 << 27) + 1], [5, 7]])
    book = np.array([[(1 << 27) - 2, -(1 << 27) + 3], [5, 6], [5, 6]])
    assert [x.tolist() for x in vector_codes.nearest(points, book)] == [[0, 1], [5, 1]]


# -- WARC --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, bytes long, id long, copy int, payload string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_pages(pages, least=0):
    out, groups = [], defaultdict(list)
    for k, (i, url, html) in enumerate(pages):
        groups[html or ""].append((i is None, i or 0, url is None, url or "", k))
    for html, own in groups.items():
        own.sort()
        size, (none, first, *_) = len(html.encode()), own[0]
        for place, (missing, i, *_) in enumerate(own):
            revisits = place > 0 and size >= least
            out.append((None if missing else i, size, digest(html), "revisit" if revisits else "response", None if none or not revisits else first))
    return sorted(out, key=str)


def pages():
    texts = ["", None, "<html>a</html>", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", "é\u0000\n" * 1000, "x" * 3_000_000]
    rows = [(k, RANDOM.choice([None, f"http://h{k}.org/p?q={k}#f", "https://h.org", "odd\r\nX: 1"]), RANDOM.choice(texts[:6]) if RANDOM.random() < 0.6 else f"<p>{k}</p>") for k in range(80)]
    rows += [(200 + k, "http://copy.org/", "<p>copied</p>") for k in range(60)] + [(None, None, None), (None, "http://n.org/", "<p>none</p>"), (None, "http://n.org/", "<p>none</p>"), (300, "u", texts[6])]
    return rows + [(7, "http://same.org/", "<p>same</p>")] * 3 + [(7, "http://other.org/", "<p>same</p>"), (-3, "http://z.org/", "<p>copied</p>")]


@pytest.mark.parametrize(("least", "most"), [(0, 1000), (10, 0)])
def test_archives_there_and_back(spark, tmp_path, least, most):
    rows = pages()
    table = spark.createDataFrame([(*p, "d", 1, 2, 3, "p") for p in rows], PAGES)
    path = str(tmp_path / "warc")
    warc.write_archives(table, path, least_revisit=least, most_shared=most, archive_bytes=100_000)
    got = warc.page_captures(spark, path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_pages(rows, least)
    full = {r["response"]["record_id"]: r for r in warc.captures(spark, path).collect()}
    assert len(full) == len(rows) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in full.values())
    for r in full.values():
        record = r["response"]
        if record["type"] == "revisit":
            assert record["payload"] is None and full[record["refers_to"]]["response"]["payload_digest"] == record["payload_digest"]
        else:
            assert digest(record["payload"].decode()) == record["payload_digest"]
        assert r["requests"][0]["payload"] == b"" and r["requests"][0]["target_uri"] == record["target_uri"]


def record(kind, name, block=b"", **fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"{k.replace('_', '-')}: {v}" for k, vs in fields.items() for v in ([vs] if isinstance(vs, str) else vs)], f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Plain and record by record compressed files; concurrent records named in either direction, in chains, and without a response."""
    http = b"HTTP/1.1 200 OK\r\nX-A: 1\r\n  more\r\n\r\nhello"
    one = [record("warcinfo", "i"), record("response", "r1", http, Content_Type="application/http;msgtype=response"), record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http", WARC_Concurrent_To="<r1>"), record("metadata", "m1", b"a: 1", WARC_Concurrent_To="<q1>"), record("metadata", "m2", WARC_Concurrent_To="<m1>")]
    two = [record("response", "r2", http, WARC_Concurrent_To=["<q2>", "<m3>"]), record("request", "q2"), record("metadata", "m3"), record("request", "q9", WARC_Concurrent_To="<m9>"), record("metadata", "m9")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.warc").write_bytes(b"".join(one))
    (tmp_path / "in/two.warc.gz").write_bytes(b"".join(map(gzip.compress, two)))
    (tmp_path / "in/none.warc").write_bytes(b"")
    got = {r["capture_id"]: (r["response"] and r["response"]["record_id"], [x["record_id"] for x in r["requests"] or ()], sorted(x["record_id"] for x in r["metadata"] or ())) for r in warc.captures(spark, str(tmp_path / "in")).collect()}
    assert got == {"<r1>": ("<r1>", ["<q1>"], ["<m1>", "<m2>"]), "<r2>": ("<r2>", ["<q2>"], ["<m3>"]), "<m9>": (None, ["<q9>"], ["<m9>"]), "<i>": (None, [], ["<i>"])}
    r1 = next(r for r in warc.read_records(spark, str(tmp_path / "in")).collect() if r["record_id"] == "<r1>")
    assert r1["payload"] == b"hello" and r1["http_headers"] == {"x-a": "1 more"} and r1["payload_bytes"] == 5


def test_damaged_archives(spark, tmp_path):
    (tmp_path / "cut.warc").write_bytes(record("response", "r", b"x" * 100)[:-60])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, str(tmp_path / "cut.warc")).collect()


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.page_captures(spark, str(tmp_path / "none")).collect() == []


def test_base32(spark):
    texts = ["", "a", "é" * 99]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(F.col("t").cast("binary"))).collect()]
    assert got == [digest(t) for t in texts]
