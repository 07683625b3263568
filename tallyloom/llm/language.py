"""Language identification that fuses the text with declared language, address suffix and host priors by Bayes' rule."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, named, packed, slices, unpacked, utf8

#: The class of texts in none of the known languages: letters in no likely order.
NOISE = "und"
#: Hash classes of letter triples, and triples of a text that count at most as independent evidence.
CLASSES, MOST_EVIDENCE = 1 << 16, 60
#: Labelled documents that the text model is fitted on at most.
MOST_LABELLED = 8000
#: Probability of NOISE before any evidence, and the weight in documents of a coarser prior under a finer one.
NOISE_PRIOR, PRIOR_WEIGHT = 0.01, 20.0
#: Hosts, domains, declared languages or suffixes up to which their sums are broadcast (some 100 bytes each).
MOST_SUMS = 100_000
#: Posteriors are summed in millionths, so that sums do not depend on their order.
UNIT = 1_000_000

_PLAIN = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))
#: What opens a stretch of markup that ends elsewhere than at the next angle bracket, and what ends it.
_OPENS = re.compile(rb"<(?:!(?=--)|script\b|style\b)", re.I)
_ENDS = {b"<!": re.compile(rb"-->"), b"<script": re.compile(rb"</script\s*>", re.I), b"<style": re.compile(rb"</style\s*>", re.I)}
_BLOCK = 1 << 16


def triples(raw: bytes) -> Iterator[np.ndarray]:
    """Hash classes of the letter triples of a UTF-8 text, words set apart by single blanks, in blocks."""
    flat = b" " + b" ".join(raw.lower().translate(_PLAIN).split()) + b" "
    codes = np.frombuffer(flat, np.uint8).astype(np.uint32)
    for at in range(0, len(codes) - 2, _BLOCK):
        part = codes[at : at + _BLOCK + 2]
        yield ((part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def visible(raw: bytes) -> bytes:
    """The text of a web page with a blank for each tag, comment, script and style.

    One pass, whatever the page holds: the ends of each kind are listed once, so none is sought again for each opening.
    A comment or script without an end is a plain tag; an angle bracket without one is text.
    """
    out, at, ends = [], 0, {}
    while (start := raw.find(b"<", at)) >= 0:
        stop = -1
        if opens := _OPENS.match(raw, start):
            kind = opens[0].lower()
            if kind not in ends:
                found = [m.span() for m in _ENDS[kind].finditer(raw)]
                ends[kind] = [a for a, _ in found], [b for _, b in found]
            k = bisect_left(ends[kind][0], opens.end() + 2 * (kind == b"<!"))
            stop = ends[kind][1][k] if k < len(ends[kind][1]) else -1
        if stop < 0 and (stop := raw.find(b">", start) + 1) == 0:
            break
        out.append(raw[at:start])
        at = stop
    return b" ".join([*out, raw[at:]])


class TextModel:
    """Log-probabilities of triples in each language and, last, in noise, where all are alike."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, NOISE]
        smooth = counts + 0.05
        fitted = np.log(smooth / smooth.sum(axis=0))
        self.table = np.concatenate([fitted, np.full((CLASSES, 1), -np.log(CLASSES))], axis=1).astype(np.float32)
        known = max(1, len(languages))
        self.prior = np.log(np.array([(1 - NOISE_PRIOR) / known] * len(languages) + [NOISE_PRIOR]))

    def evidence(self, raw: bytes) -> tuple[int, np.ndarray]:
        """Triples of a text, and its log-likelihoods scaled to at most MOST_EVIDENCE of them."""
        total, n = np.zeros(len(self.languages)), 0
        for block in triples(raw):
            total += self.table[block].sum(axis=0, dtype=np.float64)
            n += len(block)
        return n, total * (min(n, MOST_EVIDENCE) / n) if n else total

    def posterior(self, evidence: np.ndarray) -> np.ndarray:
        raised = np.exp(evidence + self.prior - (evidence + self.prior).max())
        return raised / raised.sum()


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", most_labelled: int = MOST_LABELLED) -> TextModel:
    """A text model of the labelled rows, of about ``most_labelled`` of them at most: those whose digest of id and text is below a share.

    Wholly equal rows count once. What reaches the driver are sums for each language and hash class, whose number is
    fixed, however many rows or partitions there are. Null ids and empty tables are allowed; rows without a label or
    a text are left out.
    """
    rows = docs.select(F.xxhash64(named(docs, id_col), named(docs, text_col)).alias("key"), named(docs, label_col).cast("string").alias("label"), utf8(named(docs, text_col)).alias("text")).where("label is not null and length(text) > 0")
    share = min(1.0, most_labelled / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30))
    rows = rows.dropDuplicates(["key", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = found.setdefault(label, np.zeros(CLASSES, np.int64))
                for block in triples(raw):
                    counts += np.bincount(block, minlength=CLASSES)
        for label, counts in found.items():
            held = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], ["label", "class", "n"])

    sums = rows.select("label", "text").mapInArrow(run, "label string, class int, n long").groupBy("label", "class").agg(F.sum("n").alias("n")).toArrow()
    labels = sorted(set(sums.column("label").to_pylist()))
    counts = np.zeros((CLASSES, len(labels)))
    places = {label: k for k, label in enumerate(labels)}
    counts[sums.column("class").to_numpy(), [places[x] for x in sums.column("label").to_pylist()]] = sums.column("n").to_numpy()
    return TextModel(labels, counts)




def text_evidence(items: DataFrame, model: TextModel) -> DataFrame:
    """``items(text binary, markup boolean, ...)`` with the text replaced by n, evidence and belief (in millionths)."""
    shared = items.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in items.columns if c not in ("text", "markup")]
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = [own.evidence(visible(raw) if markup else raw) for raw, markup in zip(batch.column("text").to_pylist(), batch.column("markup").to_pylist(), strict=True)]
            belief = [np.rint(own.posterior(e) * UNIT).astype(np.int64) for _, e in found]
            arrays = [*[batch.column(c) for c in rest], pa.array([n for n, _ in found], pa.int64()), pa.array([e.tolist() for _, e in found], pa.list_(pa.float64())), pa.array([b.tolist() for b in belief], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "n", "evidence", "belief"])

    return items.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in rest], "n long, evidence array<double>, belief array<bigint>"]))


def _sums(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Sums of belief for each value of ``key`` that is not null; summed before the shuffle, so a hot value is cheap."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("belief")[k]) for k in range(size)]).alias(f"of_{key}"))


def _each(size: int, value) -> Column:
    return F.array(*[value(k) for k in range(size)])


def fuse(rows: DataFrame, languages: list[str], prior_weight: float = PRIOR_WEIGHT, most_broadcast: int = MOST_SUMS) -> DataFrame:
    """Adds lang, confidence and n-best evidence to ``rows(host, domain, declared, suffix, n, evidence, belief)``.

    The prior of a host is its documents' summed beliefs over its domain's, these over all documents', each coarser one
    weighing as ``prior_weight`` documents. Declared language and address suffix each contribute how likely they are
    given the language, by the same sums with one document of smoothing for each value. A document's own belief is
    taken out of every sum, so its text does not count twice. What is null contributes nothing. All tables joined here hold a row for each host, domain,
    declared language or suffix; one of at most ``most_broadcast`` rows is broadcast, so that a hot host's documents need
    not meet, a larger one is joined by shuffle, where adaptive execution splits what is hot.
    """
    size = len(languages)
    totals = rows.agg(*[F.coalesce(F.sum(F.col("belief")[k]), F.lit(0)).alias(f"t{k}") for k in range(size)], F.count_distinct("declared").alias("declared"), F.count_distinct("suffix").alias("suffix")).first()
    whole, own = sum(totals[f"t{k}"] for k in range(size)) + size * UNIT, F.col("belief")
    overall = lambda k: (totals[f"t{k}"] + UNIT - own[k]) / (whole - sum((own[j] for j in range(1, size)), own[0]))
    weight = F.lit(prior_weight * UNIT)
    for key in ("host", "domain", "declared", "suffix"):
        sums = checkpoint(_sums(rows, key, size))
        rows = rows.join(F.broadcast(sums) if sums.count() <= most_broadcast else sums, key, "left")

    def share(sums: Column, above) -> Column:
        """The smoothed share of each language in ``sums`` less the document's own; that of ``above`` where there are none."""
        less = lambda k: sums[k] - own[k]
        count = sum((less(k) for k in range(1, size)), less(0))
        return _each(size, lambda k: F.coalesce((less(k) + weight * above(k)) / (count + weight), above(k)))

    rows = rows.withColumn("wide", share(F.col("of_domain"), overall))
    rows = rows.withColumn("prior", share(F.col("of_host"), lambda k: F.col("wide")[k]))

    def likely(key: str, k: int) -> Column:
        seen = F.col(f"of_{key}")[k] - own[k]
        return F.when(F.col(key).isNull(), 0.0).otherwise(F.log((seen + UNIT) / (totals[f"t{k}"] - own[k] + UNIT * max(1, totals[key])).cast("double")))

    rows = rows.withColumn("score", _each(size, lambda k: F.log(F.greatest(F.col("prior")[k], F.lit(1e-9))) + F.col("evidence")[k] + likely("declared", k) + likely("suffix", k)))
    top = F.array_max("score")
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("score", top).cast("int"))
    mass = F.aggregate("score", F.lit(0.0), lambda total, x: total + F.exp(x - F.array_max("score")))
    return rows.withColumn("lang", best).withColumn("confidence", 1 / mass)


def accepted(min_confidence: float = 0.5) -> Column:
    """Known language, some letters, and at least the confidence asked for."""
    return (F.col("n") > 0) & (F.col("lang") != NOISE) & (F.col("confidence") >= min_confidence)


def identify(items: DataFrame, model: TextModel, min_confidence: float = 0.5) -> DataFrame:
    """``items(text, markup, host, domain, declared, suffix, ...)`` with lang, confidence and kept in place of text and evidence.

    text is UTF-8 bytes, null counting as empty; rows without letters are never kept and have the language of NOISE or of
    their priors. Any evidence may be null. The texts are read once; what follows works on a short row for each.
    """
    rest = [c for c in items.columns if c not in ("text", "markup", "host", "domain", "declared", "suffix")]
    found = fuse(checkpoint(text_evidence(items, model)), model.languages)
    return found.select(*rest, "lang", "confidence", F.coalesce(accepted(min_confidence), F.lit(False)).alias("kept"))


def from_documents(docs: DataFrame, *extra: Column, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Items of plain texts: their source is the host; markup and address are not known."""
    none = F.lit(None).cast("string")
    return docs.select(*extra, utf8(named(docs, text_col)).alias("text"), F.lit(False).alias("markup"), named(docs, host_col).cast("string").alias("host"), none.alias("domain"), none.alias("declared"), none.alias("suffix"))


def from_pages(pages: DataFrame, *extra: Column, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Items of web pages: host, its last two labels as domain, the last as suffix, and the language of the first html element that names one."""
    host = F.lower(F.try_parse_url(named(pages, url_col).cast("string"), F.lit("HOST")))
    # every html element once, then its attribute: an expression over both at once would go over the page again at each element
    elements = F.regexp_extract_all(named(pages, html_col).cast("string"), F.lit("(?i)<html[^>]*"), F.lit(0))
    languages = F.transform(elements, lambda x: F.regexp_extract(x, "(?is)^.*\\blang\\s*=\\s*[\"']?([a-z]+)", 1))
    declared = F.lower(F.get(F.filter(languages, lambda x: x != ""), F.lit(0)))
    domain, suffix = F.regexp_extract(F.substring_index(host, ".", -2), "^([^.]+\\.[^.]+)$", 1), F.substring_index(host, ".", -1)
    some = lambda x: F.when(x != "", x)
    return pages.select(*extra, utf8(named(pages, html_col)).alias("text"), F.lit(True).alias("markup"), some(host).alias("host"), some(domain).alias("domain"), some(declared).alias("declared"), some(suffix).alias("suffix"))


def keep_known(docs: DataFrame, model: TextModel, text_col: str = "text", host_col: str = "source", min_confidence: float = 0.5, most_broadcast: int = 200_000) -> DataFrame:
    """The rows of ``docs`` whose language is known, with its columns unchanged.

    Rows are recognised by two 64-bit digests of host and text. The digests of rejected rows are broadcast if a count
    shows that they are few (some 10 MB at most); otherwise they are joined by shuffle.
    """
    digests = [F.xxhash64(F.lit(seed), named(docs, host_col), named(docs, text_col)) for seed in (1, 2)]
    items = from_documents(docs, *[d.alias(f"d{k}") for k, d in enumerate(digests)], text_col=text_col, host_col=host_col)
    gone = checkpoint(identify(items, model, min_confidence).where(~F.col("kept")).select("d0", "d1").distinct())
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone
    rows = docs.select(packed(docs), *[d.alias(f"d{k}") for k, d in enumerate(digests)])
    return rows.join(gone, ["d0", "d1"], "left_anti").select(*unpacked(docs.columns))
