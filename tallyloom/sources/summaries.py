"""Session summaries: front matter and Markdown sections to one struct, or a reason why not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = {
    "Work completed": "work_completed",
    "Decisions": "decisions",
    "Files changed": "files_changed",
    "Commands and validation": "commands_and_validation",
    "Open items": "open_items",
}
FIELDS = ["title", "goal", "repository", "branch", "tags", *SECTIONS.values(), "placeholder", "reason"]
SCHEMA = "title string, goal string, repository string, branch string, tags array<string>, " + ", ".join(f"{n} array<string>" for n in SECTIONS.values()) + ", placeholder boolean, reason string"
#: Front matter that has to agree with itself.
AGREE = (("source_prefix_hash", "source_hash"), ("source_cursor_records", "source_cursor"), ("source_cursor_bytes", "source_bytes"))


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def front_matter(lines: list[str]) -> dict[str, str | list[str]]:
    """Keys with scalars and flat lists, which is all that summaries use."""
    out: dict[str, str | list[str]] = {}
    key = None
    for line in lines:
        if line.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(line.lstrip()[2:]))
        elif ":" in line and not line.startswith((" ", "\t")):
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else _scalar(value)
    return out


def parse(document: str | None) -> dict:
    """FIELDS of one summary; reason is null if it can be told."""
    empty = dict.fromkeys(FIELDS) | {n: [] for n in ("tags", *SECTIONS.values())} | {"placeholder": False}
    lines = (document or "").replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---" or "---" not in (x.strip() for x in lines[1:]):
        return empty | {"reason": "not-an-archive"}
    end = next(k for k, x in enumerate(lines[1:], 1) if x.strip() == "---")
    head = front_matter(lines[1:end])
    if any(a in head and b in head and head[a] != head[b] for a, b in AGREE):
        return empty | {"reason": "inconsistent"}
    out = empty | {"repository": head.get("repository") or None, "branch": head.get("branch") or None, "tags": head.get("tags") if isinstance(head.get("tags"), list) else []}
    if head.get("summary_placeholder") == "true":
        return out | {"placeholder": True, "reason": "placeholder"}
    section, goal = None, []
    for line in lines[end + 1 :]:
        if line.startswith("## "):
            section = line[3:].strip()
        elif line.startswith("# ") and out["title"] is None:
            out["title"] = line[2:].strip()
        elif section == "Goal" and line.strip():
            goal.append(line.strip())
        elif section in SECTIONS and line.lstrip().startswith(("- ", "* ")):
            out[SECTIONS[section]].append(line.lstrip()[2:].strip())
        elif section in SECTIONS and line.startswith((" ", "\t")) and line.strip() and out[SECTIONS[section]]:
            out[SECTIONS[section]][-1] += " " + line.strip()
    out["goal"] = " ".join(goal) or None
    return out if out["title"] else empty | {"reason": "not-an-archive"}


def parsed(document: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in column], columns=FIELDS)

    return run(document)


def summaries(blobs: DataFrame) -> DataFrame:
    """The table of the summary operators for blobs (source_hash, archived_at, content)."""
    return blobs.select("source_hash", "archived_at", parsed(F.col("content").cast("string")).alias("s")).select("source_hash", "archived_at", "s.*")
