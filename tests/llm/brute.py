"""Plain Python versions of the operators, straight from their contracts."""

import hashlib
import re

SPACE = " \t\n\x0b\f\r"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def low(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_pii(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    spans = {k: [] for k in ("email", "ip", "card", "phone")}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            spans["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans["phone"].append(m.span())
    return spans


def line_dedup(rows: list[tuple[int, str | None]], min_chars: int = 10, min_docs: int = 2) -> dict[int, tuple[int, int, str]]:
    holders: dict[str, set[int]] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(low(line.strip(SPACE)), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(k := low(x.strip(SPACE))) < min_chars or len(holders[k]) < min_docs or min(holders[k]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rule_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    rep = len({i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)})
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w))
