"""An outside memory of notes: its search output, its settings, and when it may be asked."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass

# Hits taken, characters of a note, tokens that must be left, time limit, characters of a question, least similarity.
MAX_HITS, ITEM_CHARS, MIN_REMAINING, TIMEOUT_S, QUERY_CHARS, MIN_COSINE = 3, 1200, 200, 8.0, 250, 0.6
_HEADER = re.compile(r"\[(\d+)\]\s*(.+?) / (.+)")
_SETTING = re.compile(r"\s*(\w+)\s*=\s*(.*?)\s*")


@dataclass
class Drawer:
    wing: str
    room: str
    source: str
    text: str
    cosine: float | None


def parse_output(output: str) -> list[Drawer]:
    """Notes of a search output: a numbered header, source and match lines, then the body up to a rule or the next header."""
    found: list[tuple[Drawer, list[str]]] = []
    open_ = False
    for line in re.split(r"\r?\n", output):
        line = line.lstrip()
        if (m := _HEADER.fullmatch(line.rstrip())) and m[2].strip() and m[3].strip():
            found.append((Drawer(m[2].strip(), m[3].strip(), "", "", None), []))
            open_ = True
        elif line.startswith("─"):
            open_ = False
        elif open_ and line:
            drawer, body = found[-1]
            if not body and line.startswith("Source:"):
                drawer.source = line[7:].strip()
            elif not body and line.startswith("Match:"):
                m = re.search(r"(?:^|\s)cosine=(\S+)", line[6:])
                try:
                    drawer.cosine = float(m[1]) if m else None
                except ValueError:
                    drawer.cosine = None
            else:
                body.append(line.removeprefix("→").lstrip() if line.startswith("→") else line)
    out = []
    for drawer, body in found:
        drawer.text = "\n".join(body)
        if drawer.text:
            out.append(drawer)
    return out


def cut(text: str, most: int = ITEM_CHARS) -> str:
    return text if len(text) <= most else text[:most] + "…"


@dataclass
class Settings:
    enabled: bool | None = None
    wing: str | None = None
    room: str | None = None
    min_cosine: float = MIN_COSINE


def parse_settings(text: str) -> Settings:
    """Line by line, the last one wins; what can't be read is passed over."""
    out = Settings()
    for line in re.split(r"\r?\n", text):
        m = _SETTING.fullmatch(line.split("#")[0])
        if not m:
            continue
        key, value = m[1], m[2]
        plain = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        if key == "palace" and value in ("true", "false"):
            out.enabled = value == "true"
        elif key in ("palace_wing", "palace_room"):
            setattr(out, key.removeprefix("palace_"), plain.strip() or None)
        elif key == "palace_min_cosine":
            try:
                number = float(plain)
            except ValueError:
                continue
            if 0 <= number <= 2:
                out.min_cosine = number
    return out


def may_ask(explicit: bool | None, environment: str | None, settings: Settings) -> bool:
    """An explicit no, then the environment's no, then an explicit yes, then its yes, then the settings."""
    env = (environment or "").strip().lower()
    if explicit is False or env in ("0", "false", "no"):
        return False
    return bool(explicit) or env in ("1", "true", "yes") or bool(settings.enabled)


class SearchError(Exception):
    """``status``: not_installed, timeout or unparseable."""

    def __init__(self, status: str):
        super().__init__(status)
        self.status = status


def command_search(binary: str, cwd: str, timeout: float = TIMEOUT_S):
    """A search that runs the memory's own command."""

    def search(query: str, limit: int, wing: str | None, room: str | None) -> list[Drawer]:
        args = [binary, "search", query[:QUERY_CHARS], "--results", str(limit), *(["--wing", wing] if wing else []), *(["--room", room] if room else [])]
        try:
            done = subprocess.run(args, cwd=cwd, capture_output=True, timeout=timeout)
        except FileNotFoundError:
            raise SearchError("not_installed") from None
        except subprocess.TimeoutExpired:
            raise SearchError("timeout") from None
        if done.returncode:
            raise SearchError("unparseable")
        return parse_output(done.stdout.decode("utf-8", "replace"))

    return search


def attach(package: dict, edges: list[dict], query: str, search, settings: Settings, explicit: bool | None = None) -> dict:
    """Add notes to a package, best first, while tokens and size last; its statistics say what came of it."""
    from ..operators.pack import MAX_JSON_BYTES, as_json, fit_json, token_cost

    if not may_ask(explicit, os.environ.get("SPANLOOM_PALACE"), settings):
        return package
    stats = {"status": "ok", "attempted": 0, "included": 0, "dropped_for_budget": 0}
    package["stats"]["palace"] = stats
    if package["budget_tokens"] - package["used_tokens"] < MIN_REMAINING:
        return package
    if not settings.wing:
        stats["status"] = "unscoped_disabled"
        return package
    try:
        drawers = search(query, MAX_HITS, settings.wing, settings.room)
    except SearchError as e:
        stats["status"] = e.status
        return package
    taken = drawers[:MAX_HITS]
    stats["attempted"] = len(taken)
    close = [d for d in taken if d.cosine is not None and d.cosine >= settings.min_cosine]
    if not close:
        stats["status"] = "below_threshold"
        return package
    for d in close:
        text = cut(d.text)
        item = {"path": f"palace://{d.wing}/{d.room}", "start_line": 1, "end_line": 1, "symbol": None, "kind": "palace", "text": text, "why": ["palace"]}
        package["items"].append(item)
        if package["used_tokens"] + token_cost(text) > package["budget_tokens"] or len(as_json(package).encode()) > MAX_JSON_BYTES:
            package["items"].pop()
            stats["dropped_for_budget"] += 1
            break
        package["used_tokens"] += token_cost(text)
        stats["included"] += 1
    fit_json(package, edges)
    kept = sum(i["kind"] == "palace" for i in package["items"])
    stats["dropped_for_budget"] += max(0, stats["included"] - kept)
    stats["included"] = min(stats["included"], kept)
    return package
