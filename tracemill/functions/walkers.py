"""Walks over JSON of any shape: visible text, results, edited lines, working folders, blinding.

Plain Python on one value; ``udfs`` apply them to a column of JSON text in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracemill.sources.shipping import ship

DEPTH = 12
# fixed values: block types that aren't visible, keys that hold no text, keys that name a folder
HIDDEN = frozenset(("thinking", "redacted_thinking", "reasoning", "tool_result", "tool-result", "tool_use", "toolCall"))
TEXT_BLOCKS = frozenset(("text", "agentMessage", "userMessage"))
OPAQUE = frozenset(("signature", "encrypted_content", "encryptedContent", "thinking"))
IDENTIFIERS = frozenset(("signature", "id", "toolCallId", "tool_use_id", "callId"))
FOLDERS = frozenset(("cwd", "workdir", "working_directory", "workingDirectory", "workspace", "workspacePath", "root"))


@dataclass(frozen=True)
class View:
    """What a reader sees of a value: keys that are skipped, types of blocks that are hidden or are one text, and
    whether a string inside of other values is seen."""

    skipped: frozenset[str]
    hidden: frozenset[str] = frozenset()
    texts: frozenset[str] = frozenset()
    nested: bool = True

    def inside(self, block: dict) -> list:
        """A block's values that the walk goes on with; of a text block, a marked string."""
        if block.get("type") in self.hidden or (self.hidden and block.get("channel") == "analysis"):
            return []
        if block.get("type") in self.texts and isinstance(block.get("text"), str):
            return [(block["text"],)]
        return [v for k, v in block.items() if k not in self.skipped]


MESSAGE = View(OPAQUE, HIDDEN, TEXT_BLOCKS, nested=False)
RESULT = View(IDENTIFIERS)


def seen(value: object, view: View) -> Iterator[str]:
    """The strings of a value that a view shows, in order, DEPTH levels deep."""
    left: list[tuple[int, object]] = [(0, value)]
    while left:
        depth, at = left.pop()
        if isinstance(at, tuple):  # a text block's text
            yield at[0]
        elif isinstance(at, str) and (view.nested or not depth):
            yield at
        elif isinstance(at, (dict, list)) and depth <= DEPTH:
            inner = view.inside(at) if isinstance(at, dict) else at
            left += [(depth + 1, v) for v in reversed(inner) if depth < DEPTH or isinstance(v, tuple)]


def visible_text(value: object) -> Iterator[str]:
    """Text of a message that its reader sees: plain strings at the top, and text blocks."""
    return seen(value, MESSAGE)


def result_text(value: object) -> Iterator[str]:
    """Every string of a tool's result but identifiers and signatures."""
    return seen(value, RESULT)


def named_strings(value: object, levels: int = 9) -> Iterator[tuple[str, str]]:
    """Names and texts of the fields that hold a text, so many levels deep."""
    left = [(value, levels)]
    while left:
        at, more = left.pop()
        if more and isinstance(at, (dict, list)):
            left += [(v, more - 1) for v in (at.values() if isinstance(at, dict) else at)]
        if more and isinstance(at, dict):
            yield from ((k, v) for k, v in at.items() if isinstance(v, str))


def _lines(_: str, text: str) -> tuple[int, int]:
    return text.count("\n") + 1, 0


def _marked(name: str, text: str) -> tuple[int, int]:
    """A patch by its marks, headers aside; any other text by its lines."""
    if name != "patch" and not text.lstrip().startswith("*** Begin Patch"):
        return _lines(name, text)
    marks = [x[0] for x in text.split("\n") if x[:1] in ("+", "-") and x[:3] not in ("+++", "---")]
    return marks.count("+"), marks.count("-")


# fixed values: parts of the names of an edit's arguments, what was there before and what is there now
SIDES = (
    (("old", "search", "original", "before"), lambda name, text: _lines(name, text)[::-1]),
    (("new", "content", "replacement", "after", "patch", "text"), _marked),
)


def edit_lines(value: object) -> tuple[int, int]:
    """Lines that an edit's arguments add and remove; a patch counts by its marks."""
    found = [(0, 0)]
    for name, text in named_strings(value):
        side = next((count for parts, count in SIDES if any(p in name.lower() for p in parts)), None)
        found += [side(name.lower(), text)] if side else []
    added, removed = map(sum, zip(*found, strict=True))
    return added, removed


def folders(value: object, depth: int = 0) -> Iterator[str]:
    """Values of fields that name a working folder."""
    if depth > DEPTH or not isinstance(value, (dict, list)):
        return
    for key, v in value.items() if isinstance(value, dict) else ((None, x) for x in value):
        if key in FOLDERS and isinstance(v, str) and v:
            yield v
        else:
            yield from folders(v, depth + 1)


def blind(value: object, names: dict[str, str]) -> object:
    """The value with model names replaced, in keys too; keys that would collide are an error."""

    def words(text: str) -> str:
        for name in sorted(names, key=len, reverse=True):
            text = text.replace(name, names[name])
        return text

    if isinstance(value, str):
        return words(value)
    if isinstance(value, list):
        return [blind(v, names) for v in value]
    if isinstance(value, dict):
        out = {words(k): blind(v, names) for k, v in value.items()}
        if len(out) < len(value):
            raise ValueError("two keys are one without their model names")
        return out
    return value


def _loaded(text: object) -> object:
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return text


def blinded(spark: SparkSession, names: dict[str, str]) -> Callable:
    """A column function: JSON without the models' names, in canonical form; text that isn't JSON is blinded as text."""
    ship(spark)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text: object) -> str | None:
            value = blind(_loaded(text), names)
            plain = value is None or (isinstance(value, str) and not text.lstrip().startswith('"'))
            return value if plain else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        return s.map(one, na_action=None)

    return run


def udfs(spark: SparkSession) -> dict:
    """visible_text, result_text, edit_lines and folders of a column of JSON, for SQL as well."""
    ship(spark)

    def make(f: Callable, kind: str):
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: f(_loaded(t)), na_action=None)

        return run

    @F.pandas_udf("struct<added: long, removed: long>")
    def edited(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edit_lines(_loaded(t)) for t in s], columns=["added", "removed"])

    made = {
        "visible_text": make(lambda v: "\n".join(visible_text(v)), "string"),
        "result_text": make(lambda v: "\n".join(result_text(v)), "string"),
        "folders": make(lambda v: list(dict.fromkeys(folders(v))), "array<string>"),
        "edit_lines": edited,
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    return made
