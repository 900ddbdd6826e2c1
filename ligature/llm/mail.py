"""Stored mails as readable text: headers, transfer encodings, nested parts and HTML resolved.

Written for speed over a whole archive: a few regular expressions per mail, no message objects.
Broken input never fails: what can't be decoded is left as it is.
"""

from __future__ import annotations

import re
from base64 import b64decode
from collections.abc import Iterator
from html import unescape

HEADER = re.compile(r"(?:From |[!-9;-~]+[ \t]*:)")
FIELD = re.compile(r"^([!-9;-~]+)[ \t]*:[ \t]*(.*(?:\n[ \t].*)*)", re.M)
ENCODED_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?\n]*)\?=(?:\s+(?==\?[^?\s]+\?[bBqQ]\?))?")
ESCAPES = re.compile(r"(?:=[0-9A-Fa-f]{2})+")
SOFT_BREAK = re.compile(r"=[ \t]*\n")
PADDING = re.compile(r"=+")
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"\n]+)\"|([^\s;]+))", re.I)
CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([^\s;\"]+)", re.I)
HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strike|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<[!/?A-Za-z][^<>]*>")


def decoded(raw: bytes, charset: str) -> str:
    try:
        return raw.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return raw.decode("utf-8", "replace")


def unquote(text: str, charset: str = "utf-8") -> str:
    """Quoted-printable text; characters that aren't escapes stay."""
    text = SOFT_BREAK.sub("", text)
    return ESCAPES.sub(lambda m: decoded(bytes.fromhex(m[0].replace("=", "")), charset), text)


def unbase(text: str, charset: str = "utf-8") -> str:
    """Base64 text, cut short or with foreign characters; each padding ends a run, and the runs follow one another."""
    raw = []
    for run in PADDING.split(text):
        pure = NOT_BASE64.sub("", run)
        raw.append(b64decode(pure[: len(pure) - (len(pure) % 4 == 1)] + "=" * (-len(pure) % 4)))
    return decoded(b"".join(raw), charset)


def header_text(text: str) -> str:
    """Header lines unfolded, encoded words decoded."""
    if "=?" not in text:
        return text
    return ENCODED_WORD.sub(lambda m: unbase(m[3], m[1]) if m[2] in "bB" else unquote(m[3].replace("_", " "), m[1]), text)


def html_text(text: str) -> str:
    """HTML without tags and with entities resolved; inline tags leave no gap."""
    if "<!--" in text or "<s" in text or "<S" in text:
        text = HIDDEN.sub(" ", text)
    return unescape(TAG.sub(" ", INLINE.sub("", text)))


def parts(text: str) -> tuple[str, str]:
    """``(head, body)`` of a mail; a text that doesn't begin with a header line is a body, and no body follows a mail that ends in its header."""
    if HEADER.match(text):
        head, _, body = text.partition("\n\n")
        return head, body
    return "", text


def segments(text: str | None) -> Iterator[str]:
    """The readable texts of one mail: its header, then each text part, however deeply nested. None and empty give none."""
    if not text:
        return
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    # What is still to be read, last first: whole mails (head is None), and parts of one.
    open_: list[tuple[str | None, str]] = [(None, text)]
    while open_:
        head, body = open_.pop()
        if head is None:
            if not body:
                continue
            head, body = parts(body)
            if head:
                yield header_text(head)
            if body:
                open_.append((head, body))
            continue
        fields = {k.lower(): v for k, v in FIELD.findall(head)} if head else {}
        kind = fields.get("content-type", "").lower()
        if kind.startswith("multipart/") and (m := BOUNDARY.search(fields["content-type"])):
            mark = "--" + (m[1] or m[2])
            pieces = re.split(rf"^{re.escape(mark)}(--)?[ \t]*$\n?", body, flags=re.M)
            below = [("", pieces[0])]
            # Pieces alternate with what marks a boundary as the last; text after the last is an epilogue.
            for closed, piece in zip(pieces[1::2], pieces[2::2]):
                inner, _, rest = ("", "", piece) if closed or piece.startswith("\n") else piece.partition("\n\n")
                below.append((inner, rest))
            open_ += reversed(below)
        elif kind.startswith("message/"):
            open_.append((None, body.lstrip("\n")))
        elif not kind or kind.startswith(("text/", "multipart/")):
            how = fields.get("content-transfer-encoding", "").strip().lower()
            charset = m[1] if how and (m := CHARSET.search(fields.get("content-type", ""))) else "utf-8"
            if how.startswith("quoted"):
                body = unquote(body, charset)
            elif how.startswith("base64"):
                body = unbase(body, charset)
            yield html_text(body) if kind.startswith("text/html") else body
