"""Keyword-stuffed and link-list pages.

Of each page the sender's own words are taken (decoded plain and HTML body, without headers, quotes, signature,
attachments, logs, tables, sequences); what the HTML says again counts once. They are cut into sentences, which are what
has the structure of a clause: a capital or a sign without case at the start, a stop at the end, three to 45 words, most
of them not capitalised, few separators. A suffix automaton over the symbols of either body (words, parts of capitalised
words, numbers and the parts of links as classes, separators) gives the characters covered by repeated maximal
substrings. What stands outside of sentences and is covered by repeats to COVERED or more is stuffing; a page is a case
when this is more than half of its own characters.

Defined results: null, empty and blank texts, and texts with nothing of the sender left, are no case. Whole texts are
read, of any length, with about a kilobyte of memory a word; a null id is ignored; repeated ids are judged row by row and
come out once.
"""

from __future__ import annotations

import binascii
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the characters of a stretch without sentences that repeats must cover, and symbols it must have.
COVERED, LEAST = 0.4, 6
GREETING = re.compile(r"^\s*(?:[^\s,!:]+\s*){0,4}[,!:，、]?\s*$")
QUOTE = re.compile(r"^\s*(?:[-*]\s+)?(?:>|\||:\s|&gt;)")
WROTE = re.compile(r"^\s*(?:On|Am|Le|El)\b.*\d.*:\s*$|(?:wrote|schrieb\b.*|écrit|escribió|escribio|пиш\w+|писал\w*|написал\w*|書きました|のメッセージ|さんは)\s*:?\s*$|\b\d{1,2}:\d\d(?::\d\d)?\b.*:\s*$", re.I)
ORIGINAL = re.compile(r"^\s*-{2,}\s*\S.*\S\s*-{2,}\s*$")
SIGNATURE = re.compile(r"^\s*(?:--\s*|_{5,}|-{5,}|={5,})$")
CLOSING = re.compile(
    r"^\s*(?:kind regards|best regards|regards|best wishes|all the best|best|thanks|many thanks|thank you|cheers|see you.*|yours.*|sincerely|beste grüße|viele grüße|liebe grüße|mit freundlichen grüßen|gruß|danke|vielen dank|bis .*|cordialement|bien cordialement|amicalement|merci|merci d.avance|à bientôt|bien à vous|saludos|un saludo|saludos cordiales|gracias|atentamente|hasta .*|с уважением|спасибо|всего доброго|до .*|よろしく.*|以上.*|敬具)\s*[,.!]?\s*$", re.I
)
DISCLAIMER = re.compile(r"^(?:\W*)(?:this (?:e-?)?(?:message|mail)\b.*(?:intended|sent with)|confidential\b|think of the trees|you receive this (?:e-?)?mail|views expressed|sent from my|diese nachricht|ce message|este mensaje|это сообщение|このメール)", re.I)
LOG = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d|\s*\[?(?:INFO|WARN|ERROR|DEBUG)\b")
TABLE = re.compile(r"\s*\S+(?:\s\S+)?(?:(?:\s{2,}|\t|\s?\|\s?)-?\d[\d.,%]*)+\s*$")
DIGIT = re.compile("[0-9]")
NO_DIGITS, NO_BLANKS = str.maketrans("", "", "0123456789"), str.maketrans("", "", " \t")
SEQUENCE = re.compile(r"^\s*(?:>\S.*|[A-Za-z*-]{25,}|(?:[ACDEFGHIKLMNPQRSTVWYX]{6,}\s*)+)$")
BULLET = re.compile(r"^\s*(?:[-*•·+#]+|\(?\d{1,3}[.)])\s+")
URL = re.compile(r"<?(?:https?://|www\.)[^\s<>\"]+>?", re.I)
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]")
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
KANA = re.compile(r"[\u3041-\u3096]")
SEPARATOR = re.compile(r"[|/·•*;,#+~»>=、・，]+|\s[-–—]\s")
STOP = re.compile(r"(?<=[.?!。！？])(?=\s|$)|(?<=[。！？])")
SYMBOL = re.compile(r"<?(?:https?://|www\.)[^\s<>\"]+>?|[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,:]\d+)*|[^\w\s]|_")
LINK_PART = re.compile(r"https?://|www\.|[A-Za-z]+|\d+|.")
HUMP = re.compile(r"[^\W\d_]?[^\WA-Z\d_]+|[A-Z]+(?![^\WA-Z\d_])")
CONTACT = re.compile(r"^[^@]{0,80}[\w.+-]+@[\w-]+\.[\w.-]+[^@]{0,20}$")
BROKEN = re.compile("[ÐÑÃâ][\u0080-\u00bf\u2018-\u203a\u20ac\u0192\u02c6\u02dc\u0152-\u0178]")
HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]{1,40}:(?:\s|$)")


def _headers(text: str) -> tuple[dict[str, str], str]:
    """Header fields (lower case) and the rest; a text that doesn't begin with a field has none."""
    lines, fields, last = text.split("\n"), {}, None
    for i, line in enumerate(lines):
        if not line.strip():
            return fields, "\n".join(lines[i + 1 :]) if fields else text
        if line[0] in " \t" and last:
            fields[last] += " " + line.strip()
        elif HEADER.match(line):
            last = line.split(":", 1)[0].lower()
            fields[last] = line.split(":", 1)[1].strip()
        else:
            return fields, "\n".join(lines[i:])
    return fields, ""


def _decoded(fields: dict[str, str], body: str) -> str:
    how = fields.get("content-transfer-encoding", "").strip().lower()
    packed = body.strip()
    if how == "base64" or not how and len(packed) > 80 and re.fullmatch(r"(?:[A-Za-z0-9+/]{60,80}\n)+[A-Za-z0-9+/]*={0,2}", packed):
        letters = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            raw = binascii.a2b_base64(letters[: len(letters) // 4 * 4] if len(letters) % 4 == 1 else letters + "=" * (-len(letters) % 4))
        except binascii.Error:
            return body
    elif how == "quoted-printable" or not how and re.search(r"=\n|=[0-9A-F]{2}=[0-9A-F]{2}", body):
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    charset = re.search(r"charset=\"?([\w.-]+)", fields.get("content-type", ""), re.I)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return raw.decode(charset[1] if charset else "latin-1", "replace")
        except LookupError:
            return raw.decode("latin-1")


def _plain(markup: str) -> str:
    markup = re.sub(r"(?is)<(style|script|head|blockquote)\b.*?(?:</\1>|$)|<!--.*?-->", "\n", markup)
    markup = re.sub(r"(?is)<a\b[^>]*?href=[\"']?([^\"'\s>]+)[^>]*>", lambda m: f" <{m[1]}> " if re.match(r"(?i)https?:|www\.", m[1]) else " ", markup)
    markup = re.sub(r"<((?:https?:|www\.)[^>]+)>\s*(?=\1)", "", markup)
    markup = re.sub(r"(?i)<li\b[^>]*>", "\n- ", markup)
    markup = re.sub(r"(?i)<br\s*/?>\n?", "\n", markup)
    markup = re.sub(r"(?i)</?(?:p|div|tr|ul|ol|table|h\d|hr|body)\b[^>]*>", "\n\n", markup)
    return html.unescape(re.sub(r"<(?!https?:|www\.)/?[a-zA-Z!][^>]*>", " ", markup))


def bodies_of(text: str) -> tuple[str, str]:
    """The decoded plain text of a message, and its HTML as plain text; either may be empty."""
    leaves = _leaves(text)
    return tuple(_unbroken("\n\n".join(t for k, t in leaves if k == kind)) for kind in ("plain", "html"))


def _unbroken(text: str) -> str:
    """UTF-8 that was read as Latin-1 is read again."""
    if len(BROKEN.findall(text)) * 8 > len(text):
        try:
            return text.encode("cp1252", "ignore").decode("utf-8", "ignore")
        except UnicodeError:
            pass
    return text


def _leaves(text: str) -> list[tuple[str, str]]:
    """("plain" or "html", decoded text) of the text parts of a message in their order, however deep they are nested."""
    found, todo, whole = [], [text.replace("\r\n", "\n").replace("\r", "\n")], True
    while todo:
        fields, body = _headers(todo.pop())
        kind = fields.get("content-type", "" if whole else "text/plain").lower()
        mark = None
        if whole or kind.startswith("multipart/"):
            mark = re.search(r"boundary=\"?([^\";\s]+)", fields.get("content-type", "")) or (None if kind.startswith("text/") else re.search(r"(?m)^--(\S{6,})\nContent-", body))
        if mark:
            parts = re.split(r"(?m)^--" + re.escape(mark[1]) + r"(?:--)?[ \t]*$\n?", body)[1:]
            todo += [p.lstrip("\n") for p in reversed(parts) if p.strip()]
        elif whole or kind.startswith(("text/", "multipart/")) and "attachment" not in fields.get("content-disposition", "").lower():
            body = _decoded(fields, body)
            markup = kind.startswith("text/html") or re.search(r"(?i)<html|<p style|<body", body)
            found.append(("html", _plain(body)) if markup else ("plain", body))
        whole = False
    return found


def own_items(body: str) -> list[str]:
    """What the sender wrote, as items: wrapped lines joined, a bullet or an empty line begins a new one."""
    items: list[list[str]] = []
    fresh, skipping = True, False
    lines = [x.rstrip() for x in HIDDEN.sub("", body).split("\n")]
    for i, line in enumerate(lines):
        if not line.strip():
            fresh = True
            continue
        if ORIGINAL.match(line) and any(HEADER.match(x.strip()) or re.match(r"^\s*\S+\s?:\s", x) for x in lines[i + 1 : i + 3]):
            break  # what follows is the message answered or passed on
        if QUOTE.match(line) and not re.fullmatch(r"\s*\|.*\|.*", line):
            fresh, skipping = True, False
            continue
        link = "://" in line or "www." in line
        ahead = lines[i + 1] if i + 1 < len(lines) else ""
        if line[-1] in ":：" and WROTE.search(line) or ahead[-1:] in (":", "：") and len(line) > 20 and not link and re.search(r"\d", line) and WROTE.search(ahead):
            fresh, skipping = True, False
            continue
        if SIGNATURE.match(line) or CLOSING.match(line):
            skipping, fresh = True, True
        if skipping:
            continue
        if "@" in line and CONTACT.match(line):
            continue
        if LOG.match(line) or SEQUENCE.match(line) or TABLE.match(line) or not link and DIGIT.search(line) and (len(line) - len(line.translate(NO_DIGITS))) * 2 > len(line.translate(NO_BLANKS)):
            fresh = True
            continue
        if not items and not link and len(line) < 40 and GREETING.match(line) and (line.rstrip()[-1] in ",!:，、" or len(line.split()) <= 4 and (i + 1 >= len(lines) or not lines[i + 1].strip())):
            items.append([])
            continue
        if fresh or not items or BULLET.match(line) or link and items[-1] and URL.match(line.strip()) and URL.search(items[-1][-1]):
            items.append([])
        items[-1].append(line.strip())
        fresh = False
    return [x for x in map(" ".join, filter(None, items)) if not DISCLAIMER.match(x)]


def repeated(symbols: list) -> list[int]:
    """For each place the length of the longest substring that ends there and occurs more than once, by a suffix automaton."""
    step, link, length, count, ends = [{}], [-1], [0], [0], []
    last = 0
    for s in symbols:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        count.append(1)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = cur
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                count.append(0)
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
        ends.append(cur)
    order = sorted(range(1, len(step)), key=length.__getitem__)
    for v in reversed(order):
        if link[v] > 0:
            count[link[v]] += count[v]
    best = [0] * len(step)
    for v in order:
        best[v] = length[v] if count[v] > 1 else best[link[v]]
    return [best[v] for v in ends]


def _said(item: str) -> str:
    """An item as it is compared between bodies: its words and links without bullet, blanks and punctuation."""
    return " ".join(WORD.findall(item.lower()))


def stuffing(text: str) -> tuple[int, int]:
    """Characters of stuffing and of everything the sender wrote; items of the HTML that the plain text has count once."""
    plain, markup = map(own_items, bodies_of(text))
    stuffed, total = map(sum, zip((0, 0), *_judged(plain)))
    known, new = Counter(map(_said, plain)) if markup else None, []
    for n, item in enumerate(markup):
        if known[said := _said(item)]:
            known[said] -= 1
        else:
            new.append(n)
    judged = _judged(markup) if new else []
    for n in new:
        stuffed, total = stuffed + judged[n][0], total + judged[n][1]
    return stuffed, total


def is_clause(part: str) -> bool:
    """Whether a stretch up to a stop is built like a sentence."""
    text = URL.sub(" ", part).strip()
    words = WORD.findall(text)
    kana = len(KANA.findall(text))
    if not text or text[-1] not in ".?!。！？" or not (3 <= len(words) <= 45 or kana >= 3):
        return False
    first = text.lstrip("|\"'«(¿¡“„- \t")[:1]
    if not first.isalnum() or first.islower() and (text[-1] == "!" or len(words) < 4) or text[-1] == "!" and SEPARATOR.match(text):
        return False
    pieces = sum(1 for x in SEPARATOR.split(text) if x.strip())
    capitals = sum(w[0].isupper() for w in words)
    return kana >= 3 or pieces * 4 <= len(words) + 4 and capitals * 5 <= len(words) * 3


def symbols(part: str) -> list[tuple[str, int]]:
    """The symbols of a stretch and their lengths: words in lower case, capitalised parts of a word apart; numbers, and words and numbers in links, as classes."""
    out = []
    for m in SYMBOL.finditer(part):
        x = m[0]
        if "://" in x or x[:5].lower().lstrip("<").startswith("www."):
            for y in LINK_PART.findall(x):
                out.append(("\x00" + ("a" if y.isalpha() else "0" if y.isdigit() else y), len(y)))
        elif x[0].isdigit():
            out.append(("0", len(x)))
        elif x.islower() or len(x) < 4 or x[1:].islower():
            out.append((x.lower(), len(x)))
        else:
            out += [(y.lower(), len(y)) for y in HUMP.findall(x)]
    return out


def stretches(item: str) -> list[tuple[str, bool]]:
    """An item cut into sentences (True) and what stands between them (False)."""
    out: list[tuple[str, bool]] = []
    for part in STOP.split(BULLET.sub("", item)):
        if not part.strip():
            continue
        clause = is_clause(part)
        if out and not clause and not out[-1][1]:
            out[-1] = (out[-1][0] + part, False)
        else:
            out.append((part, clause))
    return out


def _judged(items: list[str]) -> list[tuple[int, int]]:
    """Of each item of one body the characters of stuffing and all."""
    parts = [(n, part, clause) for n, item in enumerate(items) for part, clause in stretches(item)]
    out = [(0, 0)] * len(items)
    # Only a stretch outside of sentences can be stuffing; without one of LEAST symbols no coverage is asked for.
    read = [None if clause else symbols(part) for _, part, clause in parts]
    asked = any(one and len(one) >= LEAST for one in read)
    if asked:
        read = [symbols(part) if one is None else one for one, (_, part, _) in zip(read, parts)]
        found = [x for one in read for x in one]
        lengths = repeated([x for x, _ in found])
        covered, until = [0] * len(found), len(found)
        for i in range(len(found) - 1, -1, -1):
            until = min(until, i - lengths[i] + 1) if lengths[i] else until
            covered[i] = found[i][1] if i >= until else 0
            if i == until:
                until = len(found)
    first = 0
    for (n, part, clause), one in zip(parts, read):
        stuffed, chars = False, len(part.strip())
        if asked:
            stuffed = not clause and len(one) >= LEAST and sum(covered[first : first + len(one)]) >= COVERED * sum(x for _, x in one)
            first += len(one)
        out[n] = (out[n][0] + stuffed * chars, out[n][1] + chars)
    return out


def stuffed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """id_col of the pages of which more than `share` of the sender's own characters are stuffing."""

    def run(batches):
        for b in batches:
            ids = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stuffed, total = stuffing(text)
                if stuffed > share * total:
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], [id_col])

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).filter(f"{id_col} is not null and trim(text) <> ''")
    return rows.mapInArrow(run, f"{id_col} long").distinct()
