"""Credentials in source text (problem 7).

Every literal near an assignment context (a name and a separator, a header, a connection string, a
sentence that gives a value away, an issuer's prefix, a key's marker) is segmented into dictionary
words by Viterbi. What no word explains decides: it must reach the bar of its context, and what the
name says only lowers or raises that bar. Hashes, ids, public keys, references and placeholders are no
secrets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.vocabulary import DEFAULT, read_words, unexplained


class Secret(NamedTuple):
    line: int  # 1-based, at line feeds
    begin: int  # in the text
    end: int
    kind: str


# Words that name a secret, by how much of the value must be unexplained.
_PASSWORD = frozenset("password passwd passwort passphrase pwd pw pass kennwort contraseña clave senha пароль".split())
_SECRET = frozenset("secret token apikey apitoken authtoken secretkey accesskey privatekey credential credentials auth".split())
_NOT_A_KEY = frozenset("public pub foreign primary sort partition cache unique map index object row column order hot short idempotency answer".split())
_TAIL = frozenset("value plain text raw prod dev test old new current default main backup base64 b64 live staging".split())
# What stands for a value that is not there.
_PLACEHOLDER = re.compile(
    r"(?ix)^(?: (.)\1*  | [<\[{(%$].* | .*(?:\$\{|\{\{|\$\(|<[a-z].*>|%\(|%s).* | (?:vault|env|ssm|arn|secret|secretref|ref|op|kms|file|keyring|sops|akv|gcp|aws)[:/].*"
    r" | (?:process\.env|os\.environ|os\.getenv|env\.|secrets?\.|config\.|settings\.|process\.).* "
    r" | .*(?:replace|change|insert|fill|put)[-_ ]?(?:me|this|it|in|here|with).* | .*(?:your|my|the|some)[-_ ].*(?:here|key|token|secret|password|value).* | .*(?:example|dummy|placeholder|redacted|sample|todo|fixme|changeme)(?:[-_ ]?\w{0,8})?"
    r" | x{3,}.* | (?:null|none|nil|undefined|true|false|string|str|text|bool|int|optional|required|password|passwd|secret|token|pass|pwd|test|foo|bar|hunter|hidden)[-_\d]{0,2} )$"
)
_HASH = re.compile(r"(?i)^(?:(?:sha\d{1,3}|md5|blake\w*|etag|w/)[-:=\"].+ | [0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128} | [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12} | \$(?:2[abxy]|argon2\w*|[156y]|scrypt|pbkdf2[\w-]*)\$.+ | ssh-\w+.* | ecdsa-.* )$".replace(" ", ""))
# Prefixes that issuers give their tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abeoprs]-[\w-]{16,}|AIza[\w-]{35}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{60,}|shp(?:at|ss)_[0-9a-fA-F]{30,}|[a-z]{2,8}_(?:live|prod)_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9_])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|[\s\"'+,|>#/*;-])*(?:[A-Za-z0-9-]+: [^\n\\]*(?:\\n|\s)+)*[\s\"'#/*;-]*([A-Za-z0-9+/=]{16,})")
_NOTHING_LEFT = re.compile(r"[\s\"'\\]*\Z")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_HEADER = re.compile(r"(?i)(?:authorization|proxy-authorization)[\"'`]?\s*[:=,]\s*[\"'`]?\s*(?:bearer|basic|token|digest|apikey)\s+([^\s\"'`,;]{6,})|(?<![\w-])bearer\s+([A-Za-z0-9_\-.=+/]{20,})")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`]+)@")
_NAMED = re.compile(
    r"([^\W\d][\w.-]{0,80})[\"'`]?\]?\)?\s*(?:\|\|=|\?\?=|:=|=>|=|:(?!:)|,(?=\s*[\"'`]))\s*(?:[A-Za-z]{1,2}(?=[\"']))?(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`|([^\s\"'`,;(){}\[\]<>]+))"
)
_FLAG = re.compile(r"(?<!\S)--?([A-Za-z][\w-]*)(?:\s+|=)(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'`;|&]+))")
_PAIR = re.compile(r"(?i)\bname[\"']?\s*[:=]\s*[\"']?([\w.-]+)[\"']?\s*,\s*[\"']?value[\"']?\s*[:=]\s*(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'`,}]+))")
_TAG = re.compile(r"<([A-Za-z][\w.-]*)(?:\s[^<>\n]*)?>([^<>\n]+)</")
_OPEN = re.compile(r"([^\W\d][\w.-]{0,80})[\"'`]?\]?\s*(?:\|\|=|\?\?=|:=|=|:)\s*(?:[|>][+-]?\d?|\(|\\)?\s*$")
_ALONE = re.compile(r"\s*(?:[#/*-]+\s+)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|([^\s\"'`,;(){}\[\]<>]+))\s*[,;)+\\]*\s*$")
_SAID = re.compile(
    r"(?i)(?<![\w-])((?:[\w-]+[_ -])?(?:passwords?|passwort|passwd|kennwort|passphrase|pwd|pw|login|logins|credentials?|secret|token|key|contraseña|clave|mot de passe|пароль|[a-z]+(?:Key|Secret|Token|Password)))(?![\w-])((?:\s+[\w/]+){0,6}?\s*(?:is|was|are|were|:|=|/|ist|war|lautet|est|es|será|remains|stays|set to)\s*[\"'`]?)([^\s\"'`,;]{6,})"
)
_STATED = re.compile(r"(?<![\w-])([^\W\d][\w-]{0,80})[\"'`]?\s+(?:is|was|are|were|ist|war|lautet|est|es|remains|stays)\s*:?\s*[\"'`]?([^\s\"'`,;]{6,})")
_JOINED = re.compile(r"[\"'`](?:\s*(?:\+|\.|\\|&|\|\|)?\s*\n\s*(?:\+|\.|\|\|)?\s*|[ \t]*(?:\+|\.|&|\|\|)[ \t]*|[ \t]+)[\"'`]([^\"'`\n]+)(?=[\"'`])")
# A line of a private key's body or header, as it may stand in code.
_PEM_LINE = re.compile(r"[\s\"'`+,|>#/*;.&\\-]*(?:[A-Za-z0-9-]+: .*|[A-Za-z0-9+/=]*)[\s\"'`+,;.&\\)]*")
# What a line with a secret has somewhere, in lower case.
_TRIGGERS = tuple("pass pwd kennwort secret token key auth bearer credential login contrase clave senha парол pw akia asia eyj _live_ _prod_ xox ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat aiza sg. npm_ hf_ dop_v1 shpat shpss".split()) + ("mot de", "@")
_INNER = re.compile(r"[;\"'`\s=]([A-Za-z][\w ]{0,40})=([^;\"'`\s]{4,})(?=;[A-Za-z][\w ]*=|;?[\"'`]|;?$)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^\w]+|_+")


def name_kind(name: str) -> str | None:
    """`password`, `secret`, `key` or None for what a name says its value is."""
    parts = [p.lower() for p in _CAMEL.split(name) if p]
    while parts and (parts[-1] in _TAIL or parts[-1].isdigit()):
        parts.pop()
    if not parts:
        return None
    if parts[-3:] == ["access", "key", "id"]:
        return "secret"
    if parts[-1] in _PASSWORD:
        return "password"
    if parts[-1] in _SECRET:
        return "secret"
    if parts[-1] == "key" or (parts[-1].endswith("key") and len(parts[-1]) > 5):
        return None if set(parts[:-1]) & _NOT_A_KEY or parts[-1] in ("publickey", "primarykey", "foreignkey", "monkey", "turkey", "hockey", "hotkey") else "key"
    return None


class Bar(NamedTuple):
    """What a value in a context must reach."""

    rest: int  # unexplained characters
    length: int = 6
    rest_with_digit: int = 99  # instead of `rest`, where the value has a digit
    rest_without_digit: int = 0  # at least this where it has none


# By context: how telling it is, the lower the bar.
BARS = {
    "url": Bar(2), "header": Bar(6), "issued": Bar(8), "private key": Bar(8, 16),
    "password": Bar(5, rest_with_digit=2), "said": Bar(5, 8, 2), "secret": Bar(8, 12, rest_without_digit=12), "key": Bar(8, 12, rest_without_digit=12),
}


def _excluded(value: str, kind: str, bare: bool) -> bool:
    """Values of a known form that are no secrets."""
    if len(value) < 6 or _PLACEHOLDER.match(value):
        return True
    if kind in ("issued", "private key"):
        return value.upper().endswith("EXAMPLE")
    digits = sum(c.isdigit() for c in value)
    if value.startswith(("ssh-", "ecdsa-", "$2", "-----", "http://", "https://")) or re.match(r"(?i)sha\d{1,3}[-:]", value) or re.match(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", value):
        return True
    if (kind in ("key", "said") and _HASH.match(value)) or (" " in value and not digits) or (bare and not digits and kind != "header"):
        return True
    if digits == len(value) and kind not in ("header", "url"):
        return kind != "password" or bare  # a number is only a password, and only between quotes
    return kind in ("password", "said") and digits < len(value) and not any(c.isalpha() for c in value)


def _is_secret(value: str, kind: str, words: dict[str, float], bare: bool) -> bool:
    if _excluded(value, kind, bare):
        return False
    bar, digit = BARS[kind], any(c.isdigit() for c in value)
    rest = unexplained(value, words)
    return len(value) >= bar.length and (rest >= bar.rest or (digit and rest >= bar.rest_with_digit)) and (digit or rest >= bar.rest_without_digit)


_CODE = frozenset("ts tsx js jsx mjs cjs py go rs java kt rb php c h cc cpp hpp cs swift scala".split())
_COMMENT = re.compile(r"\s*(?:#|//|--|/?\*|;|<!--|%|rem\b|\"\"\"|''')", re.IGNORECASE)


def find_secrets(text: str, path: str, words: dict[str, float]) -> list[Secret]:
    """All secrets of one text, in order, none inside another."""
    found: list[Secret] = []
    low = text.lower()
    if not any(k in low for k in _TRIGGERS):
        return found
    code = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() in _CODE
    at, opened = 0, None
    for no, (line, plain) in enumerate(zip(text.split("\n"), low.split("\n"), strict=True), 1):
        here: list[tuple[int, int, str]] = []

        def take(m: re.Match, group: int, kind: str, bare: bool = False, line: str = line, here: list = here) -> bool:
            value = m[group]
            begin, end = m.span(group)
            while value and value[-1] in (".,;:!?)" if kind == "said" and not re.search(r"\d[!?]$", value) else ",;"):
                value, end = value[:-1], end - 1
            if not _is_secret(value, kind, words, bare):
                return False
            here.append((begin, end, kind))
            return True

        if opened:
            if m := _ALONE.match(line):
                g = next(i for i in (1, 2, 3, 4) if m[i] is not None)
                take(m, g, opened, g == 4)
            opened = None
        if any(k in plain for k in _TRIGGERS):
            for m in _PEM.finditer(line):
                body = _PEM_BODY.match(text, at + m.end())
                if _NOTHING_LEFT.match(text, at + m.end()) or (body and _is_secret(body[1], "private key", words, False)):
                    here.append((m.start(), m.end(), "private key"))
            for m in _ISSUED.finditer(line):
                take(m, 0, "issued")
            for m in _HEADER.finditer(line):
                take(m, 1 if m[1] else 2, "header")
            for m in _URL.finditer(line):
                take(m, 2, "url")
            comment = bool(_COMMENT.match(line))
            at_name = 0
            while m := _NAMED.search(line, at_name):
                at_name = m.start() + len(m[1]) + 1
                kind = name_kind(m[1])
                if kind:
                    g = next((i for i in (2, 3, 4, 5) if m[i] is not None), 5)
                    bare = g == 5
                    if bare and code and not comment:
                        continue
                    if take(m, g, kind, bare):
                        at_name = m.end(g)
            if ";" in line:
                for m in _INNER.finditer(line):
                    if kind := name_kind(m[1]):
                        take(m, 2, kind)
            for rx, groups in ((_FLAG, (2, 3, 4)), (_PAIR, (2, 3, 4)), (_TAG, (2,))):
                for m in rx.finditer(line):
                    if kind := name_kind(m[1]):
                        g = next(i for i in groups if m[i] is not None)
                        take(m, g, kind, g == groups[-1] and len(groups) > 1)
            if comment or not code:
                for m in _STATED.finditer(line):
                    if (kind := name_kind(m[1])) and re.search(r"[A-Za-z]", m[2]) and re.search(r"\d", m[2]):
                        take(m, 2, "secret" if kind == "key" else kind, True)
                for m in _SAID.finditer(line):
                    direct = name_kind(m[1].split(" ")[-1])
                    strict = "said"
                    if direct and re.fullmatch(r"\s*(?:is|was|:|=|ist|war|lautet|est|es)\s*[\"'`]?", m[2]):
                        strict = "secret" if direct == "key" else direct
                    if re.search(r"[A-Za-z]", m[3]) and re.search(r"\d", m[3]):
                        take(m, 3, strict, True)
            if m := _OPEN.search(line):
                opened = name_kind(m[1])
        last = -1
        for begin, end, kind in sorted(here):
            if begin >= last:
                found.append(Secret(no, at + begin, at + end, kind))
                last = end
        at += len(line) + 1
    return found


def _headless(text: str) -> int:
    """Where the body of a private key ends with which the text begins, its opening marker lost; 0 without one."""
    m = _PEM_END.search(text)
    if not m or _PEM.search(text, 0, m.start()):
        return 0
    lines = re.split(r"\n|\\[nr]", text[: m.start()])
    return m.start() if all(_PEM_LINE.fullmatch(x) for x in lines) else 0


def blot(text: str, secrets: list[Secret]) -> str:
    """The text with each secret's characters replaced by `*`: length, lines and the code around stay as they are.

    A private key is blotted from its marker to its end marker, or from the text's start if it begins
    inside the key, and a literal in several pieces in all its pieces.
    """
    out = list(text)
    if head := _headless(text):
        secrets = [Secret(1, 0, 0, "private key"), *(s for s in secrets if s.begin >= head)]
    for s in secrets:
        spans = [(s.begin, s.end)]
        if s.kind == "private key":
            m = _PEM_END.search(text, s.end)
            spans = [(s.end, m.start() if m else len(text))]
        else:
            end = s.end
            while m := _JOINED.match(text, end):
                spans.append(m.span(1))
                end = m.end(1)
        for a, b in spans:
            i = a
            while i < b:
                if s.kind == "private key" and text[i] == "\\" and text[i + 1 : i + 2] in ("n", "r"):
                    i += 2  # an escaped line break is code, not key
                    continue
                if s.kind == "private key" and not (text[i].isalnum() or text[i] in "+/="):
                    i += 1
                    continue
                if text[i] not in "\r\n":
                    out[i] = "*"
                i += 1
    return "".join(out)


_FOUND = "id bigint, line_no int, begin int, length int, kind string"
_SPANS = "array<struct<line_no: int, begin: int, length: int, kind: string>>"


def scan(chunks: DataFrame, text: str = "chunk_text", path: str = "file_path", spans: str = "secrets", out: str = "redacted", vocabulary: str = DEFAULT) -> DataFrame:
    """`chunks` with the secrets of each text in `spans` and the text without them in `out`, in one pass over whole Arrow batches.

    Existing columns of these names are replaced. A null text gives null in both, one without secrets
    comes out as it is with an empty list. A null path counts as unknown. Texts are read whole.
    """
    words = chunks.sparkSession.sparkContext.broadcast(read_words(vocabulary))

    @F.pandas_udf(f"spans {_SPANS}, clean string")
    def run(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        found = [None if x is None else find_secrets(x, y or "", words.value) for x, y in zip(t, p, strict=True)]
        rows = [None if f is None else [{"line_no": s.line, "begin": s.begin, "length": s.end - s.begin, "kind": s.kind} for s in f] for f in found]
        return pd.DataFrame({"spans": pd.Series(rows, dtype=object), "clean": pd.Series([None if f is None else blot(x, f) for x, f in zip(t, found, strict=True)], dtype=object)})

    names = [F.col(f"`{c}`") for c in chunks.columns if c not in (spans, out)]
    both = chunks.select("*", run(F.col(f"`{text}`"), F.col(f"`{path}`")).alias("__scan"))
    return both.select(*names, F.col("__scan.spans").alias(spans), F.col("__scan.clean").alias(out))


def secrets_in(chunks: DataFrame, id: str = "id", text: str = "chunk_text", path: str = "file_path", vocabulary: str = DEFAULT) -> DataFrame:
    """One row for each secret: id, line_no, begin (0-based character), length and kind; never the secret itself.

    Repeated rows count once. Null and empty texts have no secrets, a null path counts as unknown, null
    ids are left out, an empty table gives an empty result. Texts are read whole, however long.
    """
    words = chunks.sparkSession.sparkContext.broadcast(read_words(vocabulary))
    rows = chunks.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"), F.coalesce(F.col(f"`{path}`"), F.lit("")).alias("p")).where("id is not null and t is not null")

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, s.line, s.begin, s.end - s.begin, s.kind) for i, t, p in zip(b["id"], b["t"], b["p"], strict=True) for s in find_secrets(t, p, words.value)]
            yield pd.DataFrame(out, columns=["id", "line_no", "begin", "length", "kind"])

    return rows.mapInPandas(op, _FOUND).distinct()


def redact(chunks: DataFrame, text: str = "chunk_text", path: str = "file_path", out: str = "redacted", vocabulary: str = DEFAULT) -> DataFrame:
    """`chunks` with the text, its secrets blotted out, in `out` (an existing column of that name is replaced).

    Texts without secrets come out as they are; null stays null.
    """
    return scan(chunks, text, path, "__spans", out, vocabulary).drop("__spans")
