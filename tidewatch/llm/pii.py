"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, schemes and cue words.  At each anchor a
deterministic parser reads to both sides, sets the boundaries and validates (dotted quads, Luhn, digit counts, mod 97).
Every parser is linear in the text: it never reads again what a match or a failed match of its kind has consumed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import only

KINDS = ("email", "ip", "card", "phone", "url", "account", "address", "secret")
BASE = KINDS[:4]

# The words that stand for an account, an address or a secret.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "straße", "strasse", "rue", "calle", "avenida", "plaza")
SECRET_CUES = ("token", "api_key", "apikey", "password", "secret")
SCHEMES = ("http://", "https://", "ftp://", "www.")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"[\x20().0-9-]*")
URL = re.compile(r"(?:https?://|ftp://|www\.)[^\x20\x09-\x0D<>\"']+")
ACCOUNT = re.compile(r"[\x20:#.=-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){5,16})")
STREET_NUMBER = re.compile(r"\x20([0-9]{1,5}[a-z]?)(?![0-9A-Za-z])")
SECRET = re.compile(r"\x20?[=:]\x20?[\"']?([A-Za-z0-9_/+.-]{8,})")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("address", STREET_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then kind; the end is exclusive."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # end of what each kind has consumed
    at_floor = 0
    for last, (kind, size) in _automaton().iter(text):
        start, end = last + 1 - size, last + 1
        if kind == "digit":
            if start >= done["ip"]:
                chain = QUADS.match(text, start)
                done["ip"] = chain.end()
                parts = chain.group().split(".")
                here = start
                for i in range(0, len(parts) - 3, 4):
                    quad = parts[i : i + 4]
                    length = sum(map(len, quad)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in quad):
                        out.append(("ip", here, here + length))
                    here += length + 1
            if start >= done["card"]:
                run = DIGITS.match(text, start)
                if run is None:
                    done["card"] = end
                else:
                    done["card"] = run.end()
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", start, run.end()))
        elif kind == "at":
            floor = max(done["email"], at_floor)
            left = start
            while left > floor and text[left - 1] in LOCAL:
                left -= 1
            at_floor = end
            host = DOMAIN.match(text, end) if left < start else None
            if host is not None:
                out.append(("email", left, host.end()))
                done["email"] = host.end()
        elif kind == "plus":
            if start >= done["phone"] and text[end : end + 1].isascii() and text[end : end + 1].isdigit():
                stop = PHONE.match(text, end).end()
                while not "0" <= text[stop - 1] <= "9":
                    stop -= 1
                if stop - end >= 3:
                    done["phone"] = stop
                    if 10 <= sum("0" <= c <= "9" for c in text[start:stop]) <= 15:
                        out.append(("phone", start, stop))
        elif kind == "url":
            found = URL.match(text, start) if start >= done["url"] else None
            if found is not None:
                stop = found.end()
                while stop > end and text[stop - 1] in ".,;:!?)*&#%$":
                    stop -= 1
                if stop > end:
                    out.append(("url", start, stop))
                    done["url"] = found.end()
        elif kind == "address":
            begin, stop = _address(text, start, end) if start >= done[kind] and not text[end : end + 1].isalnum() else (0, 0)
            if stop:
                out.append((kind, begin, stop))
                done[kind] = stop
        elif start >= done[kind] and not text[max(0, start - 1) : start].isalnum():
            if kind == "account":
                found = ACCOUNT.match(text, end)
                if found is not None and (found[1][0].isdigit() or _iban(found[1])):
                    out.append((kind, found.start(1), found.end(1)))
                    done[kind] = found.end()
            elif kind == "secret":
                found = SECRET.match(text, end)
                if found is not None:
                    out.append((kind, found.start(1), found.end(1)))
                    done[kind] = found.end()
    rank = {k: i for i, k in enumerate(KINDS)}
    out.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
    return out


def _address(text: str, start: int, end: int) -> tuple[int, int]:
    """Expand a street word: ``12 High Street`` to the left, ``Hauptstraße 12`` or ``Calle Mayor 5`` to the right."""
    begin = start
    while begin and start - begin < 40 and text[begin - 1].isalpha():  # compounds
        begin -= 1
    after = STREET_NUMBER.match(text, end)
    if after is not None:
        return begin, after.end(1)
    before = re.search(r"(?<![0-9A-Za-z])[0-9]{1,5}(?:\x20[A-Z][a-z]+){1,3}\x20$", text[max(0, begin - 60) : begin])
    if before is not None:
        return begin - len(before.group()), end
    return 0, 0


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per input row.

    ``spans`` lists all finds as ``kind:start:end``; ``base_sha256`` covers the four base kinds.  Null and empty texts have
    none.  Equal starts are ordered by kind.  Repeated rows, and rows without id, are treated like any other; further
    columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                counts: list[list[int]] = [[], [], [], []]
                shas, lists = [], []
                for value in part.column(1):
                    found = find(value.as_py() or "")
                    base = [s for s in found if s[0] in BASE]
                    for n, kind in zip(counts, BASE, strict=True):
                        n.append(sum(s[0] == kind for s in base))
                    shas.append(hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest())
                    lists.append(",".join("%s:%d:%d" % s for s in found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array(shas, pa.string()), pa.array(lists, pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    rows = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with every find replaced by its kind; of overlapping finds the one that starts first wins."""
    if not text:
        return text
    out, here = [], 0
    for kind, start, end in find(text):
        if start >= here:
            out += [text[here:start], f"<{kind}>"]
            here = end
    return "".join([*out, text[here:]])
