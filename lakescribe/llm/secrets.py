"""Secret scans: all rules as one minimal automaton that reads each byte once."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.llm.automaton import combine_dfas, compile_dfa, rows_of
from lakescribe.llm.common import code_points, fresh, per_text, sha256, span_digest


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    pattern: what a match is; matches are leftmost, longest and do not overlap within a kind. Of two matches,
    the one that starts first must not reach its first end later (true where a rule has one literal head).
    min_length: shorter matches are dropped after they have taken their place. head: the part in front of
    the secret's value, of which min_value characters are needed. any_case: letters stand for both cases.
    extent: where a match found by the pattern goes on; its longest form counts.
    """

    kind: str
    pattern: str
    any_case: bool = False
    min_length: int = 0
    head: str = ""
    min_value: int = 0
    extent: str = ""


_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_GAP = r"(\x20|\t|\r|\n|\\r|\\n)"  # blanks and line ends, also as they are escaped in strings
_FIELD = r"[A-Za-z][A-Za-z0-9-]*:\x20(-?[\x20-,.-~])*"  # as Proc-Type; no two hyphens, so that no scan passes another key
#: A key up to its last line; if that is missing, as far as long lines of base64 and a padded one go; else its first line.
_KEY = (
    _BEGIN + rf"(({_GAP}+({_FIELD}|[A-Za-z0-9+/=]+))*{_GAP}*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|({_GAP}+{_FIELD})*({_GAP}+[A-Za-z0-9+/=]{{32,}})+({_GAP}+[A-Za-z0-9+/]*=+)?)?"
)
#: The first three are the base kinds. The count in hex keeps the automaton quiet in plain text.
RULES = (
    Rule("assign", _HEAD + r"[A-Za-z0-9+/_.=-]+", any_case=True, head=_HEAD, min_value=6),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", _BEGIN, extent=_KEY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", min_length=20),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", min_length=39),
)
BASE = ("assign", "access", "hex")


@functools.lru_cache(maxsize=4)
def _tables(rules: tuple[Rule, ...]) -> tuple:
    """Automata of the rules: all together; then of each rule anywhere, from its start, backward, its head."""
    forward = [compile_dfa(r.pattern, r.any_case) for r in rules]
    each = tuple(
        (combine_dfas([f]), compile_dfa(r.extent, r.any_case) if r.extent else f, compile_dfa(r.pattern, r.any_case, backward=True), compile_dfa(r.head, r.any_case) if r.head else None)
        for r, f in zip(rules, forward, strict=True))
    return combine_dfas(forward), each


class Scanner:
    """Finds the spans of all rules in a text, as (kind, start byte, end byte)."""

    def __init__(self, rules: tuple[Rule, ...], tables: tuple) -> None:
        self.rules = rules
        self.all = rows_of(*tables[0])
        self.each = [[rows_of(*x) if x else None for x in one] for one in tables[1]]

    @staticmethod
    def _longest(row: list, text: bytes, start: int) -> int:
        """End of the longest match from `start`; -1 if there is none."""
        end = start if row[256] else -1
        for i in range(start, len(text)):
            row = row[text[i]]
            if row[256]:
                end = i + 1
            elif row[257]:
                break
        return end

    @staticmethod
    def _earliest(row: list, text: bytes, end: int, bound: int) -> int:
        """Start of the longest match that ends at `end` and starts at `bound` or later; -1 if there is none."""
        found = -1
        for i in range(end - 1, bound - 1, -1):
            row = row[text[i]]
            if row[256]:
                found = i
            elif row[257]:
                break
        return found

    def _rest(self, rule: int, text: bytes, start: int, out: list) -> None:
        """Matches of one rule from `start` on, with an automaton that begins anew after each match."""
        anywhere, forward, backward, _ = self.each[rule]
        row, i, size = anywhere, start, len(text)
        while i < size:
            row = row[text[i]]
            i += 1
            if row[256]:
                s = self._earliest(backward, text, i, start)
                start = i = self._longest(forward, text, s)
                out.append((rule, s, i))
                row = anywhere

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of the accepted matches, by start, then rule."""
        found: list[tuple[int, int, int]] = []
        free = [0] * len(self.rules)
        row = self.all
        for i, byte in enumerate(text):
            row = row[byte]
            if row[256]:
                mask = row[256]
                for r in range(len(free)):
                    if mask >> r & 1 and i >= free[r]:
                        s = self._earliest(self.each[r][2], text, i + 1, free[r])
                        if s < 0:  # a match that began inside the last one: this rule goes on alone from there
                            self._rest(r, text, free[r], found)
                            free[r] = len(text)
                        else:
                            free[r] = self._longest(self.each[r][1], text, s)
                            found.append((r, s, free[r]))
        return sorted((x for x in found if self._holds(text, *x)), key=lambda x: (x[1], x[0]))

    def _holds(self, text: bytes, r: int, start: int, end: int) -> bool:
        rule = self.rules[r]
        if rule.head and end - self._longest(self.each[r][3], text[:end], start) < rule.min_value:
            return False
        return end - start >= rule.min_length


_SCHEMA = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def _worker(rules: tuple[Rule, ...]):
    tables = _tables(rules)  # compiled on the driver: some hundred states, sent with the task

    def make():
        scanner = Scanner(rules, tables)

        def work(texts):
            rows = []
            for text in texts:
                spans = scanner.spans(text)
                at = code_points(text, [x for _, s, e in spans for x in (s, e)])
                named = [(rules[r].kind, at[s], at[e]) for r, s, e in spans]
                base = [x for x in named if x[0] in BASE]
                counts = [sum(x[0] == k for x in base) for k in BASE]
                rows.append((*counts, sha256(span_digest(base)), span_digest(named)))
            return list(zip(*rows, strict=True))

        return work

    return make


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns the kept columns, n_assign, n_access, n_hex, base_sha256 (digest of the spans of these kinds) and
    spans (all kinds; code points, end exclusive). Null and empty texts have no spans. Rows are independent:
    repeated rows give equal results, an empty table gives none, other columns are ignored.
    """
    return per_text(docs, _worker(rules), _SCHEMA, keep)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The documents with each secret replaced by a mark; overlapping spans become one mark. Null stays null.

    All columns stay as they are, but for the text and, where there is one, n_chars.
    """
    tables = _tables(rules)

    def make():
        scanner = Scanner(rules, tables)

        def work(texts):
            return [[_redacted(scanner, text, mark) for text in texts]]

        return work

    names = docs.columns
    made = fresh("redacted", names)
    done = per_text(docs, make, T.StructType([T.StructField(made, T.StringType())]), keep=names, text_col=text_col)
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.col(made))
    shown = {text_col: text.alias(text_col)}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed = F.col(made) != F.col(f"`{text_col}`")
        shown["n_chars"] = F.when(changed, F.length(made).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return done.select(*[shown.get(c, F.col(f"`{c}`")) for c in names])


def _redacted(scanner: Scanner, text: bytes, mark: str) -> str:
    parts, at = [], 0
    for _, s, e in scanner.spans(text):
        if e <= at:
            continue
        if s >= at:
            parts += [text[at:s].decode(), mark]
        at = e
    return "".join(parts) + text[at:].decode()
