"""License scan with ordered signature rules.

Rules are gated by their keyword, so most texts meet no pattern at all.
Detections are taken by priority, then length, then place; one that lies inside
a detection already taken is dropped. The base phrases are always reported.

Words are runs of a-z, 0-9 and characters from U+0080 on, after A-Z became
lower case. Cases: null and empty texts have no words, empty labels, null first
and last word and score 0; whole texts are scanned, however long; repeated rows
are scanned each; other columns are not read.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.arrow import map_batches
from rankloom.llm.license_rules import BASE, Rule, build_rules

_WORD = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


@functools.cache
def _gates() -> list[tuple[str, list[Rule]]]:
    gates: dict[str, list[Rule]] = {}
    for rule in build_rules():
        gates.setdefault(rule.keyword, []).append(rule)
    return list(gates.items())


def _places(text: str, phrase: str) -> list[int]:
    """Starts of a phrase as whole words; places may share words."""
    out, at = [], text.find(phrase)
    while at >= 0:
        if text[at - 1] == " " and text[at + len(phrase)] == " ":
            out.append(at)
        at = text.find(phrase, at + 1)
    return out


def detections(joined: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) left after suppression, in text order."""
    found = []
    for keyword, rules in _gates():
        if keyword in joined:
            for rule in rules:
                for hit in rule.pattern.finditer(joined):
                    found.append((rule.priority, hit.start() - hit.end(), hit.start(), hit.end(), rule))
    found.sort(key=lambda x: x[:4])
    kept = uncontained([(start, end) for _, _, start, end, _ in found])
    return sorted((found[k][2], found[k][3], found[k][4].label, found[k][4].confidence) for k in kept)


def uncontained(spans: list[tuple[int, int]]) -> list[int]:
    """Places of the spans that lie in no earlier kept one.

    A tree of greatest ends over the starts (as Fenwick sums prefixes) tells whether
    a kept span that begins no later ends no sooner.
    """
    order = {start: k + 1 for k, start in enumerate(sorted({start for start, _ in spans}))}
    ends, kept = [-1] * (len(order) + 1), []
    for place, (start, end) in enumerate(spans):
        k, furthest = order[start], -1
        while k:
            furthest = max(furthest, ends[k])
            k &= k - 1
        if furthest >= end:
            continue
        kept.append(place)
        k = order[start]
        while k < len(ends):
            ends[k] = max(ends[k], end)
            k += k & -k
    return kept


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base = [], set()
    for phrase, label in BASE.items():
        if phrase in joined and (hits := _places(joined, phrase)):
            places += hits
            base.add(label)
    kept = detections(joined)
    at = [joined.count(" ", 0, p) - 1 for p in (min(places), max(places))] if places else [None, None]
    score = max([0.6 * bool(base), *(x[3] for x in kept)])
    labels = base | {x[2] for x in kept}
    return len(words), len(places), *at, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document."""

    def work(batches):
        for batch in batches:
            rows = [scan(t) for t in batch.column("text").to_pylist()]
            yield [batch.column("doc_id").cast(pa.int64()), *([r[k] for r in rows] for k in range(7))]

    return map_batches(
        docs.select("doc_id", "text"),
        work,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double",
    )
