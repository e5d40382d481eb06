"""Raw e-mail to decoded text: MIME parts, markup to lines, and what the sender wrote themselves.

The parser takes what archives hold: mbox lines, folded, shuffled or missing headers, any line ends, parts without a
closing boundary, truncated encodings. It never raises on a text; null and empty texts give no parts.
"""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from typing import NamedTuple


class Part(NamedTuple):
    kind: str  # "plain", "html" or another text subtype
    text: str
    attached: bool
    alternative: int  # number of the multipart/alternative that holds it, 0 for none


_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*("([^"]*)"|[^\s;]+)')
_B64_LINE = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}$")
_MARKUP = re.compile(r"\s*<(?:html[\s>]|!doct)", re.I)
_NOT_B64 = re.compile(r"[^A-Za-z0-9+/]+")


def _headers(text: str) -> tuple[dict[str, str], str]:
    """Headers by lower-case name (the first of each) and the body; a text without headers is all body."""
    at, n = 0, len(text)
    while at < n and text[at] == "\n":
        at += 1
    start = at
    found: dict[str, str] = {}
    name = ""
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        if not line.strip():
            return found, text[end + 1 :]
        if line[0] in " \t" and name:
            found[name] += " " + line.strip()
        elif _HEADER.match(line):
            key, _, value = line.partition(":")
            name = key.strip().lower()
            if name in found:
                name += "+"
            found[name] = value.strip()
        elif at == start and line.startswith(("From ", ">From ")):
            pass
        elif found:
            return found, text[at:]
        else:
            return {}, text[start:]
        at = end + 1
    return found, ""


def _params(value: str) -> dict[str, str]:
    return {m[1].lower(): m[3] if m[3] is not None else m[2] for m in _PARAM.finditer(value)}


def _charset(raw: bytes, name: str) -> str:
    for c in (name, "utf-8"):
        try:
            return raw.decode(c or "utf-8")
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return raw.decode("latin-1")


def _decode(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.strip().lower()
    if encoding == "base64" or (not encoding and _looks_base64(body)):
        data = _NOT_B64.sub("", body)
        data = data[: len(data) - (len(data) % 4 == 1)]
        try:
            return _charset(binascii.a2b_base64(data + "=" * (-len(data) % 4)), charset)
        except binascii.Error:
            return body
    if encoding == "quoted-printable":
        return _charset(binascii.a2b_qp(body.encode("utf-8", "replace")), charset)
    return body


def _looks_base64(body: str) -> bool:
    lines = body.split("\n", 4)[:3]
    return len(lines) > 1 and all(_B64_LINE.fullmatch(x.strip()) for x in lines[:2])


def parts(text: str | None) -> list[Part]:
    """The text parts of a message in order; other parts are left out."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[Part] = []
    alternatives = 0
    pending = [(text, 0)]  # what is still to be read, the next piece last; nesting may be of any depth
    while pending:
        piece, alternative = pending.pop()
        head, body = _headers(piece)
        kind = head.get("content-type", "")
        main = kind.split(";", 1)[0].strip().lower()
        if main.startswith("multipart/"):
            boundary = _params(kind).get("boundary")
            if not boundary and (m := re.search(r"^--(\S.*)$", body, re.M)):
                boundary = m[1].rstrip()
            if boundary:
                if main == "multipart/alternative":
                    alternatives += 1
                    alternative = alternatives
                pending += [(p, alternative) for p in reversed(list(_pieces(body, boundary)))]
                continue
        if main and not main.startswith(("text/", "multipart/", "message/")):
            continue
        content = _decode(body, head.get("content-transfer-encoding", ""), _params(kind).get("charset", "utf-8"))
        if main == "message/rfc822":
            pending.append((content, alternative))
            continue
        sub = main[5:] if main.startswith("text/") else "plain"
        if sub == "plain" and _MARKUP.match(content):
            sub = "html"
        if "\r" in content:
            content = content.replace("\r\n", "\n").replace("\r", "\n")
        out.append(Part(sub, content, head.get("content-disposition", "").lower().startswith("attachment"), alternative))
    return out


def _pieces(body: str, boundary: str) -> Iterator[str]:
    """What lies between the boundary lines, up to the closing one; the last piece may have none after it."""
    mark, begin, at = "--" + boundary, -1, 0
    while (at := body.find(mark, at)) >= 0:
        end = body.find("\n", at)
        end = len(body) if end < 0 else end
        tail = body[at + len(mark) : end].rstrip(" \t")
        if (at == 0 or body[at - 1] == "\n") and tail in ("", "--"):
            if begin >= 0:
                yield body[begin:at]
            if tail:
                return
            begin = min(end + 1, len(body))
        at += len(mark)
    if begin >= 0:
        yield body[begin:]


_DROP = re.compile(r"<(head|style|script)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_QUOTE = re.compile(r"<(/?)blockquote\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|tr|table|h\d|li|ul|ol|pre|hr|body|html)\b[^>]*>", re.I)
_BREAK = re.compile(r"<br\s*/?>\n?", re.I)
_TAG = re.compile(r"<[^<>]*>")


def html_lines(markup: str, mark_quotes: bool = False) -> str:
    """Markup to text; with ``mark_quotes`` the lines of block quotes begin with '> '."""
    text = _DROP.sub("", markup)
    if mark_quotes and "blockquote" in text.lower():
        out, level, at = [], 0, 0
        for m in _QUOTE.finditer(text):
            out.append(_plain(text[at : m.start()], level))
            level, at = max(0, level + (-1 if m[1] else 1)), m.end()
        out.append(_plain(text[at:], level))
        return "\n".join(out)
    return _plain(_QUOTE.sub("\n", text), 0)


def _plain(markup: str, level: int) -> str:
    text = _BLOCK.sub("\n", _BREAK.sub("\n", markup))
    text = html.unescape(_TAG.sub("", text)).replace("\xa0", " ")
    if level:
        return "\n".join("> " + x for x in text.split("\n") if x.strip())
    return text


def readable(part: Part) -> str:
    return html_lines(part.text) if part.kind == "html" else part.text


_WORD = re.compile(r"[^\W_]+")
_SOFT = re.compile("[­​-‍﻿]")


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(_SOFT.sub("", text).lower() if not text.isascii() else text.lower())


#: A paragraph with one cue of small print is small print up to so many words.
FEW_WORDS = 40

# ---- what the sender wrote -------------------------------------------------------------------------------------

#: Openings and closings of letters, words of disclaimers, and rulers.
_GREETING = re.compile(r"(?:hi|hello|hey|dear|morning|good (?:morning|afternoon|evening|day)|hallo|hola|bonjour|shalom|greetings)\b[^.?!]{0,40}$|[A-Z֐-׿][\w'-]+(?: [A-Z][\w'-]+)?\s*[,:]$|(?:all|team|everyone|folks)\s*[,:]$", re.I)
_NAME_GREETING = re.compile(r"[A-Z][\w'-]+(?: [A-Z][\w'-]+)?\s*[,:–-]$")
_CLOSING = re.compile(r"(?:best|best wishes|best regards|cheers|regards|kind regards|warm regards|many thanks|thanks|thank you|thx|sincerely|yours(?: \w+)?|all the best|br|take care|ciao|gru(?:ß|ss)|viele gr(?:ü|ue)(?:ß|ss)e|mit freundlichen gr(?:ü|ue)(?:ß|ss)en|saludos|cordialement|best)\s*[,.!-]*$", re.I)
_RULER = re.compile(r"\s*[_=*~#-]{8,}\s*$")
_SMALL_PRINT = (
    ("confidential", "privileged"), ("disclaim",), ("intended only", "intended solely", "intended exclusively", "intended recipient", "intended for the"), ("unauthorised", "unauthorized", "un-authori", "prohibited", "not the intended", "not the named"),
    ("no liability", "not liable", "accept no", "accepts no", "cannot guarantee", "not indicative", "no warrant"), ("delete", "destroy", "notify the", "notify us", "in error"), ("consider the environment", "before printing", "think before"),
    ("sent from my",), ("unsubscribe", "mailing list"), ("expressed", "does not constitute", "past performance"), ("virus", "registered office", "registered in", "registered number"),
)
_ORIGINAL = re.compile(r"\s*-{2,}\s*(?:original message|forwarded message|urspr\S+ nachricht|mensaje original|message d'origine)\s*-{2,}\s*$|\s*begin forwarded message:?\s*$", re.I)
_FIELD = re.compile(r"\s*\*?(?:from|sent|to|cc|date|subject|von|gesendet|an|betreff|de|enviado|para|asunto)\*?\s*:", re.I)
_INTRO_END = re.compile(r"(?:wrote|writes|schrieb|escribi\S+|a \xe9crit|כתב|>)[^:]{0,80}:\s*$|:\s*$", re.I)


def body_text(found: list[Part]) -> str:
    """The message's own body: of an alternative its plain part, else its markup; attachments are left out."""
    out, seen = [], {}
    for p in found:
        if p.attached or p.kind not in ("plain", "html"):
            continue
        text = html_lines(p.text, mark_quotes=True) if p.kind == "html" else p.text
        if p.alternative:
            if p.alternative in seen:
                k, kind = seen[p.alternative]
                if kind == "html" and p.kind == "plain" and text.strip():
                    out[k], seen[p.alternative] = text, (k, "plain")
                elif not out[k].strip():
                    out[k], seen[p.alternative] = text, (k, p.kind)
                continue
            seen[p.alternative] = (len(out), p.kind)
        out.append(text)
    return "\n".join(out)


def own_text(body: str) -> str:
    """The body without quotes and their introductions, greeting, closing, signature and disclaimer.

    Paragraphs are kept apart by blank lines.
    """
    lines = [x.rstrip() for x in body.split("\n")]
    kept = "\n\n".join(_segment(s) for s in _unquoted(lines))
    return kept.strip()


def _unquoted(lines: list[str]) -> list[list[str]]:
    """Runs of lines that are not quoted."""
    for k, line in enumerate(lines):
        if _ORIGINAL.match(line):
            above = lines[:k]
            if len(words(_segment(_drop_marked(above)))) >= 3 or any(len(words(_segment(s))) >= 3 for s in _marked(above)):
                return _marked(above)
            return _marked(above) + [_below_original(lines[k + 1 :])]
    return _marked(lines)


def _drop_marked(lines: list[str]) -> list[str]:
    return [x for s in _marked(lines) for x in s]


def _marked(lines: list[str]) -> list[list[str]]:
    out, run = [], []
    quoted = False
    for line in lines:
        if line.lstrip()[:1] in (">", "|") and line.strip():
            if not quoted:
                _drop_intro(run)
                out.append(run)
                run = []
            quoted = True
        else:
            if line.strip():
                quoted = False
            run.append(line)
    out.append(run)
    return [r for r in out if any(x.strip() for x in r)]


def _drop_intro(run: list[str]) -> None:
    """Takes the line or two that introduce a quote off the end of the run before it."""
    while run and not run[-1].strip():
        run.pop()
    if run and _INTRO_END.search(run[-1]):
        k = len(run) - 1
        while k > 0 and run[k - 1].strip() and len(run) - k < 3:
            k -= 1
        intro = " ".join(run[k:])
        if "@" in intro or re.search(r"\d|wrote|schrieb|escrib|crit", intro):
            del run[k:]


def _below_original(lines: list[str]) -> list[str]:
    """The reply below an unmarked original: behind its header block, greeting, text and closing."""
    k = 0
    while k < len(lines) and (_FIELD.match(lines[k]) or not lines[k].strip()):
        k += 1
    rest = lines[k:]
    starts = [i for i, x in enumerate(rest) if _is_greeting(rest, i)]
    first = starts[0] if starts and not any(x.strip() for x in rest[: starts[0]]) else -1
    later = [i for i in starts if i > first]
    if later:
        return rest[later[-1] :]
    closings = [i for i, x in enumerate(rest) if _is_closing(rest, i)]
    if len(closings) > 1:
        return rest[closings[-2] + 2 :]
    # no mark between the two: the reply is wrapped to another width
    paragraphs, run = [], []
    for i, x in enumerate(rest[first + 1 :], first + 1):
        if x.strip():
            run.append(i)
        elif run:
            paragraphs.append(run)
            run = []
    if run:
        paragraphs.append(run)
    widths = [max(len(rest[i]) for i in p) if len(p) > 1 else 0 for p in paragraphs]
    known = [w for w in widths if w]
    for k in range(1, len(paragraphs)):
        before, after = [w for w in widths[:k] if w], [w for w in widths[k:] if w]
        gap = paragraphs[k][0] - paragraphs[k - 1][-1] > 2
        if gap or (before and after and widths[k] and abs(max(before) - widths[k]) > 5 and abs(max(before) - min(before)) <= 5):
            return rest[paragraphs[k][0] :]
    return rest if not known else rest[first + 1 :]


def _is_greeting(lines: list[str], i: int) -> bool:
    x = lines[i].strip()
    if not x or len(x) > 60 or len(x.split()) > 5:
        return False
    alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
    return alone and not _CLOSING.match(x) and bool(_GREETING.match(x) or _NAME_GREETING.match(x))


def _is_closing(lines: list[str], i: int) -> bool:
    x = lines[i].strip()
    return bool(x) and len(x) < 40 and bool(_CLOSING.match(x)) and (i == 0 or not lines[i - 1].strip())


def _is_disclaimer(paragraph: str) -> bool:
    """Two of the cues of legal small print, or one in a paragraph of few words."""
    low = paragraph.lower()
    cues = sum(any(c in low for c in cue) for cue in _SMALL_PRINT)
    return cues > 1 or (cues == 1 and len(paragraph.split()) <= FEW_WORDS)


def _segment(run: list[str]) -> str:
    out: list[str] = []
    begun = False
    for i, line in enumerate(run):
        x = line.strip()
        if x == "--" or _RULER.match(line) or _is_closing(run, i):
            break
        if x and (i == 0 or not run[i - 1].strip()):
            k = i
            while k < len(run) and run[k].strip():
                k += 1
            if _is_disclaimer(" ".join(run[i:k])):
                break
        if x and not begun:
            begun = True
            if _is_greeting(run, i):
                continue
        out.append(x)
    return "\n".join(out).strip()
