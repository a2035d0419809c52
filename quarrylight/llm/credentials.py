"""Credentials embedded in source text, found and redacted.

A line is a chain of lexical tokens. A linear-chain conditional random field
labels each token as credential or not, from the token's shape and from what
stands around it; the Viterbi path decides, and exactly the characters of the
labelled tokens are redacted. A complete PEM block is one token.

The field is trained here, on lines composed from lists of names and values
(``training_lines``); no corpus text and no downloaded model is used.

Defined cases: null and empty texts hold nothing; placeholders, references to
variables, digests, ids, public keys and certificates are not credentials; a
block without its end is not one; every line of any length is read; repeated
rows count once; ``line_no`` counts line feeds. A token of fewer than eight
characters or without a digit is looked at where a value stands: in quotes,
after ``:`` or ``=``, between tags, after an option, a scheme or words that
announce it; from 16 characters drawn by lot, anywhere.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import distinct_texts, hot_keys, spread_join

# ---- tokens ----------------------------------------------------------------

_PEM = r"-----BEGIN [A-Z0-9 ]{0,40}?(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE|KEY BLOCK)[A-Z ]{0,20}-----(?=.{40})(?>[^-]+|-(?!----))*+-----END [A-Z0-9 ]{3,60}-----"
#: A literal continued by another one: one value in several pieces.
_GLUE = r"[\"'`][ \t]*(?:[+.\\][ \t]*\r?\n?|\r?\n)[ \t]*(?:[+.][ \t]*)?[\"'`]"
_CAT = rf"[\w.+/~*!#%^&\-]{{4,}}=*(?:{_GLUE}[\w.+/~*!#%^&\-]{{4,}}=*)+(?=[\"'`])"
_JOIN = re.compile(_GLUE)
_GOES_ON = re.compile(r"[\"'`][ \t]*(?:[+.\\][ \t]*)?\r?$")
_FOLLOWS = re.compile(r"[ \t]*(?:[+.][ \t]*)?[\"'`]")
_IS_NAME = re.compile(r"[\"'`]?\s*(?::(?!//)|=(?!=))")
#: A value with an at sign in it, whole in quotes or up to the end of an assignment; an address has its sign between other parts.
_SIGNED = r"(?<=[\"'`])(?!\S*://)[\w.+/~*!#%^&\-]+@[\w.+/~*!#%^&\-@]*(?=[\"'`])|(?<=[:=>\s])(?<![:/]/)(?!\S*://)[A-Za-z0-9+~*!#%^&\-]+@[A-Za-z0-9+~*!#%^&\-]+(?=[\s;,<)]|$)"
_TOKEN = re.compile(
    rf"(?P<pem>{_PEM})|(?P<cat>{_CAT})|(?P<word>{_SIGNED}|[\w.+/~*!#%^&\-]+=*(?=[\"'`\s),;<>\\]|$)|[\w.+/~*!#%^&\-]+)|(?P<mark>[^\w\s])", re.S
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")
#: A token of eight characters with a digit is looked at wherever it stands, any other where a value stands.
MIN_LENGTH = 8
#: A token without a digit that is looked at wherever it stands, if its letters look drawn by lot.
DRAWN_LENGTH = 16

#: Parts of names that speak for or against a credential.
PASS = {"pass", "password", "passwd", "passphrase", "pwd", "clave", "contrasena", "contraseña", "senha", "motdepasse", "passwort", "kennwort", "login"}
SECRET = {"secret", "token", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "private", "signing", "hmac", "salt", "webhook", "hook", "access", "activation", "license", "jwt", "oauth", "cookie", "pin", "code", "basic", "dsn", "signature"}
PLAIN = {"sha", "sha1", "sha256", "sha512", "md5", "digest", "checksum", "etag", "hash", "commit", "revision", "ref", "integrity", "trace", "uuid", "guid", "pixel", "fingerprint", "cert", "certificate", "public", "base64", "image", "version", "build", "rev", "tree", "blob", "parent", "nonce", "span", "request", "correlation", "resolved", "data", "font", "woff", "svg"}
META = {"field", "name", "column", "label", "count", "budget", "url", "uri", "size", "length", "type", "title", "path", "file", "limit", "ttl", "expires", "policy", "prompt", "hint", "placeholder", "help"}
FILLER = {"content", "value", "values", "const", "let", "var", "final", "static", "private", "string", "export", "insert", "into", "settings", "meta", "user", "name", "https", "http", "def", "self"}
HOLD = ("example", "changeme", "change", "your", "here", "todo", "replace", "placeholder", "dummy", "sample", "redacted", "notset", "not-set", "xxxx", "****", "fake", "insert", "none", "null", "undefined", "test-", "....")
PREFIX = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|sk[-_](?:live|test|ant|proj)?|rk_live|pk_live|npm_|pypi-|hf_|SG\.|shp(?:at|ss)_|dop_v1_|ya29\.|EAAC)[\w.\-]{8,}$")
_JWT = re.compile(r"eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}$")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_GROUPS = re.compile(r"[A-Z0-9]{4,8}(?:-[A-Z0-9]{4,8}){2,}$")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+$")
_CONSTANT = re.compile(r"[%$]?[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%?$")
_NUMBER = re.compile(r"[\d.,:/+\-%]+$|\d[\d.]*[a-z]{0,3}$")


class Token:
    __slots__ = ("text", "start", "end", "kind")

    def __init__(self, text: str, start: int, end: int, kind: str):
        self.text, self.start, self.end, self.kind = text, start, end, kind


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    return [Token(m[0], m.start(), m.end(), m.lastgroup) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def eligible(token: Token) -> bool:
    """Whether a token is looked at wherever it stands."""
    if token.kind == "pem":
        return True
    t = token.text
    return token.kind in ("word", "cat") and len(t) >= MIN_LENGTH and any(c.isdigit() for c in t)


#: What stands before a value without quotes.
_TOLD = r"(?:password|passwd|pwd|clave|contraseña|secret|token|login)\b[^=:\"']{0,24}\b(?:was|is|era|es|now)\s*:?\s*|login\s*:?\s*[\w.\-]+\s*/\s*"
_TOLD_NEXT = re.compile(rf"(?:{_TOLD})$", re.I)
_IDENTIFIED = re.compile(r"\bidentified\s+by\s*.$", re.I)
_ANNOUNCES = {"basic", "bearer", "token", "password", "passwd", "pwd", "clave", "secret"}
_CAMEL = re.compile(r"[a-zà-ÿ]*(?:[A-ZÀ-Þ][a-zà-ÿ]+)*$|[A-ZÀ-Þ]+$")
_UNSPOKEN = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", re.I)


def placed(token: Token, text: str) -> bool:
    """Whether a token of any length, with or without a digit, stands where a value stands."""
    if token.kind not in ("word", "cat"):
        return False
    last = text[token.start - 1 : token.start]
    if last in ("'", '"', "`", ":", "=") or last == ">" and text.startswith("</", token.end):
        return True
    if len(token.text) >= DRAWN_LENGTH and plain_shape(token.text) == "drawn":
        return True
    if last not in (" ", "\t", "/"):
        return False
    before = text[max(0, token.start - 80) : token.start]
    said = before.split()[-1:]
    if not said:
        return False
    if said[0][-1] in ":=" or said[0].lower() in _ANNOUNCES or said[0][0] == "-":
        return True
    return (said[0] == "/" or said[0].lower() in ("was", "is", "era", "es", "now")) and bool(_TOLD_NEXT.search(before))


@lru_cache(maxsize=50_000)
def plain_shape(t: str) -> str:
    """Shape of a token that is short or has no digit."""
    parts = [p for p in re.split(r"[._\-/]+", t) if p]
    if any(c.isdigit() for c in t):
        return "brief-mixed" if any(c.isalpha() for c in t) else "brief-number"
    if re.search(r"[*!#%^&+~]", t):
        return "marked"
    if any(not _CAMEL.match(p) for p in parts) or _UNSPOKEN.search(t) and len(t) >= 10:
        return "drawn" if len(t) >= DRAWN_LENGTH else "mixed"
    return "words" if len(parts) > 1 or not (t.islower() or t.istitle()) else "word"



@lru_cache(maxsize=50_000)
def name_parts(word: str) -> tuple[str, ...]:
    return tuple(p.lower() for p in _PARTS.findall(word))


def _like(part: str, known: set[str]) -> bool:
    """Whether a name's part is a known one, two letters of a suffix allowed."""
    return part in known or any(len(w) > 2 and part.startswith(w) and len(part) - len(w) <= 2 for w in known)


@lru_cache(maxsize=50_000)
def name_class(word: str) -> str:
    parts = name_parts(word)
    joined = "".join(parts)
    plain = any(p in PLAIN for p in parts)
    kin = lambda known: any(_like(p, known) for p in parts) or joined.endswith(tuple(w for w in known if len(w) > 4))
    secret = "pass" if kin(PASS) else "secret" if kin(SECRET) else ""
    meta = any(p in META for p in parts)
    if plain:
        return "plain"
    if secret:
        return f"{secret}-meta" if meta else secret
    return "meta" if meta else "other"


def _entropy(t: str) -> float:
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in (t.count(x) for x in set(t)))


def _switches(t: str) -> float:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in t]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(t) - 1)


@lru_cache(maxsize=50_000)
def value_features(t: str, kind: str) -> tuple[str, ...]:
    """Shape of one token."""
    if kind == "pem":
        private = "PRIVATE KEY" in t[:60]
        body = re.sub(r"-----[^-]*-----", "", t)
        whole = len(re.findall(r"[A-Za-z0-9+/]{16,}", body)) >= 2 and "..." not in body
        return (f"pem={'private' if private else 'public'}{'' if whole else '-empty'}",)
    out = []
    low = t.lower()
    if any(h in low for h in HOLD) or len(set(t)) < 4:
        out.append("hold")
    if PREFIX.match(t):
        out.append("prefix")
    if _JWT.match(t):
        out.append("jwt")
    if _UUID.match(t):
        out.append("uuid")
    elif _GROUPS.match(t):
        out.append("groups")
    elif _NUMBER.match(t):
        out.append("number")
    elif _CONSTANT.match(t):
        out.append("constant")
    elif _HEX.match(t):
        out.append("hex-digest" if len(t) in (32, 40, 56, 64, 96, 128) else "hex")
    else:
        switch, n = _switches(t), len(t)
        letters = sum(c.isalpha() for c in t)
        mixed = any(c.isupper() for c in t) and any(c.islower() for c in t)
        if n >= 20 and switch > 0.35 and mixed and _entropy(t) > 3.6:
            out.append("random-long")
        elif n >= 16 and mixed and (switch > 0.3 or switch * (n - 1) >= 5 and any(c.isdigit() for c in t[1:-3])):
            out.append("random")
        elif mixed and letters >= 6 and t[-1] in "0123456789*!#%$&" or re.search(r"[A-Za-zÀ-ÿ]{3,}.*\d{1,4}(?:[*!#$&]|%\d\d)?$", t) and re.search(r"[A-Z*!#$]", t):
            out.append("passwordlike")
        else:
            out.append("wordlike")
    if "prefix" in out:
        out.append(f"prefix&{out[-1]}")
    if len(t) > 200:
        out.append("huge")
    if "/" in t and t.count("/") + t.count(".") >= 2:
        out.append("pathlike")
    if t.startswith(("//", "./", "../", "http", "#", "--")) or re.match(r"[\w\-]+(?:\.[\w\-]+)+$", t) and not _JWT.match(t) and switch_low(t):
        out.append("hostlike")
    if re.match(r"v?\d+(\.\d+)+", t):
        out.append("version")
    if t.startswith("sha") and "-" in t[:8]:
        out.append("integrity")
    return tuple(out)


def switch_low(t: str) -> bool:
    return _switches(t) < 0.3 and not re.search(r"[A-Z]", t)


def _is_basic(t: str) -> bool:
    try:
        plain = base64.b64decode(t, validate=True).decode("utf-8")
    except (ValueError, UnicodeDecodeError):
        return False
    return ":" in plain and plain.isprintable()


def plain_context(token: Token, text: str, before: str, value: str, near: str) -> list[str]:
    """How a token that is short or has no digit stands: it says less by itself than by its place."""
    before = before[-80:]
    quote = before[-1:] if before.endswith(("'", '"', "`")) else ""
    after = text[token.end : token.end + 3]
    bare = before[:-1].rstrip() if quote else before.rstrip()
    if bare.endswith(("==", "!=")):
        place = "compared"
    elif not quote and before.endswith(":") and re.search(r"@[\w.\-]+:$", before):
        place = "port"
    elif not quote and after.lstrip()[:1] in ("(", "[", "{", "."):
        place = "called"
    elif not quote:
        closed = text[token.end : token.end + 1] in ("", "\n", "\r", ";") or not text[token.end :].strip()
        place = "element" if before.endswith(">") else "bare-end" if closed else "bare"
        if before.endswith("="):
            place += "-tight"
    elif not after.startswith(quote):
        place = "sentence"
    elif bare.endswith((":", "=")) and not ("<" in before and re.search(r"<\w[^>]*$", before)):
        place = "value"
    elif bare.endswith((",", "=")) and re.search(r"values\s*\([^()]*,\s*.$|\bcontent=.$", before, re.I):
        place = "value"
    else:
        place = "listed"
    out = [f"place={place}", f"place={place}&{value}", f"place={place}&{value}&near={near}"]
    if len(token.text) < 6:
        out += [f"brief={min(4, len(token.text))}", f"brief&near={near}"]
    if name_class(token.text) in ("pass", "secret", "pass-meta", "secret-meta", "meta", "plain"):
        out.append("names-itself")
    return out


def features(line: list[Token], text: str) -> list[list[str] | None]:
    """Features of each token; None for a token that cannot be a credential."""
    out: list[list[str] | None] = []
    strong: list[str] = []  # names that say something, nearest last

    def heard(word: str) -> None:
        if word.isdigit():
            # A number between a name and a value parts them, as in the rows of a table.
            strong.clear()
        elif name_parts(word) and word.lower() not in FILLER:
            strong.append(word)

    for i, token in enumerate(line):
        known = eligible(token)
        seen = known or placed(token, text)
        named = token.kind == "word" and seen and _IS_NAME.match(text, token.end) and text[token.end - 1] != "="
        if named or not seen:
            if token.kind == "word":
                heard(token.text)
            out.append(None)
            continue
        before = text[max(0, line[0].start, token.start - 200) : token.start]
        left, right = before[-3:], text[token.end : token.end + 2]
        shown = _JOIN.sub("", token.text) if token.kind == "cat" else token.text
        f = ["bias", *value_features(shown, token.kind)]
        if not known:
            f = ["bias", f"plain={plain_shape(shown)}", *(x for x in f[1:] if x in ("hold", "prefix", "jwt", "constant", "pathlike", "hostlike"))]
            f[1:] = sorted(f[1:], key=lambda x: x != "hold")
        value = f[1] if len(f) > 1 else "none"
        near = name_class(strong[-1]) if strong else "none"
        f += [f"near={near}", f"near={near}&{value}"]
        rest = {name_class(w) for w in strong[-6:-1]}
        if rest & {"pass", "secret"}:
            f.append(f"far-secret&{value}")
        if "plain" in rest:
            f.append("far-plain")
        if left.endswith(("'", '"', "`")):
            f.append("quoted")
        elif re.search(r"[:=]\s*$", before):
            f.append("assigned")
        if left.endswith(":") and right.startswith("@"):
            f.append("url-password")
        if left.endswith("=") and re.search(r"[?&](?:access_)?(?:token|key|secret|sig|auth|password)=$", before, re.I):
            f.append("url-query")
        if left[-1:].isspace() and re.search(r"\b(?:basic|bearer|token)\s+$", before, re.I):
            f.append("scheme" + ("-basic" if _is_basic(token.text) else ""))
        if left.endswith(":") and re.search(r"(?:-u|--user)[ =][\"']?[\w.\-]+:$", before):
            f.append("cli-user")
        if before[-1:] not in ("'", '"', "`", "=", "(", ",", ">") and _TOLD_NEXT.search(before):
            f.append("told")
        if left[-1:] in ("'", '"') and _IDENTIFIED.search(before):
            f.append("identified")
        if left.endswith(("{", "<", "%", "$", "(")) and right[:1] in ("}", ">", "%", ")") and not left.endswith("("):
            f.append("template")
        if before.endswith("base64,"):
            f.append("data-uri")
        if not known:
            f = [f"plain:{x}" for x in [*f, *plain_context(token, text, before, value, near)]]
            if token.kind == "word":
                heard(token.text)
        out.append(f)
    return out


# ---- the field -------------------------------------------------------------


class Field:
    """Two labels, weights by feature, weights by label pair."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = np.zeros((2, 2))

    def scores(self, rows: list[list[str] | None]) -> np.ndarray:
        weights = self.weights
        return np.array([-1e9 if f is None else sum(weights.get(x, 0.0) for x in f) for f in rows])

    def viterbi(self, rows: list[list[str] | None]) -> list[int]:
        score = self.scores(rows)
        pairs = self.pairs.tolist()
        gain = max(map(max, pairs)) - pairs[0][0]
        if score.max() + 2 * gain < 0:
            # Each token labelled 1 costs more than its two neighbouring pairs can give.
            return [0] * len(rows)
        best, back = [0.0, score[0]], []
        for s in score[1:].tolist():
            step, kept = [], []
            for label in (0, 1):
                options = (best[0] + pairs[0][label], best[1] + pairs[1][label])
                came = int(options[1] > options[0])
                kept.append(came)
                step.append(options[came] + (s if label else 0.0))
            back.append(kept)
            best = step
        label = int(best[1] > best[0])
        path = [label]
        for kept in reversed(back):
            label = kept[label]
            path.append(label)
        return path[::-1]

    def _gradient(self, rows: list, gold: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed: of label 1 per token, and of the label pairs."""
        n = len(rows)
        node = np.zeros((n, 2))
        node[:, 1] = np.maximum(self.scores(rows), -50)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = node[0]
        for i in range(1, n):
            forward[i] = node[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.pairs, axis=0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.pairs + (node[i + 1] + backward[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        marginal = np.exp(forward + backward - total)
        pair = np.zeros((2, 2))
        for i in range(1, n):
            pair += np.exp(forward[i - 1][:, None] + self.pairs + (node[i] + backward[i])[None, :] - total)
            pair[gold[i - 1], gold[i]] -= 1
        return marginal[:, 1] - np.array(gold), pair

    def fit(self, lines: list[tuple[list, list[int]]], rounds: int = 8, rate: float = 0.5, decay: float = 2e-4) -> Field:
        rng = random.Random(11)
        squares: dict[str, float] = {}
        order = list(range(len(lines)))
        # The mean of the later rounds does not depend on which line came last.
        late, mean = rounds - rounds // 2, {}
        for done in range(rounds):
            rng.shuffle(order)
            for k in order:
                rows, gold = lines[k]
                diff, pair = self._gradient(rows, gold)
                for f, d in zip(rows, diff):
                    if f is None or abs(d) < 1e-4:
                        continue
                    for x in f:
                        g = d + decay * self.weights.get(x, 0.0)
                        squares[x] = squares.get(x, 1e-6) + g * g
                        self.weights[x] = self.weights.get(x, 0.0) - rate * g / math.sqrt(squares[x])
                self.pairs -= 0.01 * pair
            if done >= late:
                for x, w in self.weights.items():
                    mean[x] = mean.get(x, 0.0) + w / (rounds - late)
        self.weights = mean or self.weights
        return self


#: Words and names that the training lines are composed of.
_STEMS = "amber brook canyon delta falcon garden island jungle kettle lantern meadow orchid pepper quartz river sierra tulip valley winter zephyr".split()
_GOOD_PASS = ["password", "db_password", "dbPassword", "PASSWORD", "passwd", "user_pwd", "smtp_pass", "clave", "contrasena", "passphrase", "admin_password"]
_GOOD_KEY = ["api_key", "apiKey", "API_TOKEN", "secret", "client_secret", "clientSecret", "auth_token", "secret_key", "service_token", "access_token", "hmac_key", "signing_key", "webhook_secret", "activation_key", "access_code", "signing_salt", "private_key", "credential"]
_NEUTRAL = ["notifier", "git_value", "ci_header", "session_header", "worker", "remote", "s3_user", "bot", "header", "bridge"]
_META = ["password_field", "secret_name", "token_column", "passwd_label", "token_url", "key_name", "token_type", "password_hint"]


def training_lines(count: int = 2400, seed: int = 5) -> list[tuple[str, str | None]]:
    """Composed lines, each with the credential it holds (None: none)."""
    rng = random.Random(seed)
    pick = rng.choice
    stems, good_pass, good_key, neutral, meta = _STEMS, _GOOD_PASS, _GOOD_KEY, _NEUTRAL, _META
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda n, a=alnum: "".join(pick(a) for _ in range(n))

    def password() -> str:
        s = pick(stems) + pick(["", ".", "_", "-"]) + pick(stems).capitalize() + str(rng.randrange(10, 1000)) + pick(["", "*", "!", "#", "%23"])
        return s if rng.random() < 0.8 else rand(rng.randrange(10, 16))

    def basic() -> str:
        return base64.b64encode(f"{pick(stems)}:{password()}".encode()).decode()

    secrets = {
        "named": lambda: rand(rng.randrange(22, 44)),
        "hexkey": lambda: rand(pick([32, 40, 64]), "0123456789abcdef"),
        "groups": lambda: "-".join(rand(5, "ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(5)),
        "prefix": lambda: pick([lambda: pick(["ghp_", "gho_", "ghs_"]) + rand(36), lambda: f"xoxb-{rng.randrange(10**10, 10**11)}-{rand(24)}", lambda: "AKIA" + rand(16, alnum[:26] + "234567"), lambda: "glpat-" + rand(20), lambda: "AIza" + rand(35), lambda: "sk_live_" + rand(24), lambda: "npm_" + rand(36)])(),
        "jwt": lambda: f"eyJ{rand(28)}.{rand(44)}.{rand(43)}",
    }
    plain = ["commit", "checksum", "etag", "sha256", "source_digest", "pinned_revision", "base_ref", "trace_id", "request_id", "integrity", "file_hash", "build_sha", "tree_hash", "image_digest", "public_key", "cert_fingerprint"]
    hold = ["changeme", "YOUR_API_KEY_HERE1", "example-key-0001", "REPLACE_ME_2024", "********", "<api-key>", "${API_KEY_2}", "{{ vault_password2 }}", "%API_KEY_1%", "xxxxxxxx0000", "test-placeholder-1", "dummy-token-123", "not-set-00", "TODO-000000"]
    calm = ["lesson-offset-2", "v1.20.3-beta4", "src/app/page2.html", "2024-05-01T10:20:30", "utf8mb4_general2", "host12.example.com", "rank_window_44", "1234567890", "path/to/file99", "Helvetica12pt", "section_id_77b", "budget40hits"]

    def styled(name: str, value: str) -> str:
        camel = name.split("_")[0].lower() + "".join(p.capitalize() for p in name.split("_")[1:])
        if rng.random() < 0.4:
            name, camel = f"{name}_{rand(3, alnum[26:52])}", camel + rand(2)
        return pick([
            f'{name} = "{value}"', f"const {camel} = '{value}';", f'  "{name}": "{value}",', f'  {name}: "{value}"', f"export {name.upper()}=\"{value}\"",
            f'    private static final String {name.upper()} = "{value}";', f"INSERT INTO settings (name, value) VALUES ('{name}', '{value}');",
            f'  <meta name="{name}" content="{value}">', f"def open_page(retries=2, {name}='{value}'):", f"{name}: `{value}`", f"{name.upper()}='{value}'", f"  {camel}: \"{value}\",",
            f"/* {name}: {value} */", f"# {name} = {value}",
        ])

    out: list[tuple[str, str | None]] = []
    while len(out) < count:
        kind = rng.randrange(17)
        if kind <= 1:
            v = password()
            out.append((styled(pick(good_pass), v), v))
        elif kind == 2:
            v = secrets[pick(["named", "hexkey", "groups"])]()
            out.append((styled(pick(good_key), v), v))
        elif kind == 3:
            v = secrets["named"]()
            out.append((styled(pick(good_key + good_pass), v), v))
        elif kind == 4:
            v = secrets[pick(["prefix", "jwt"])]()
            out.append((styled(pick(neutral + good_key), v), v))
        elif kind == 5:
            v = password() if rng.random() < 0.5 else secrets["named"]()
            url = f"{pick(['postgresql', 'mysql', 'amqp', 'redis', 'mongodb'])}://{pick(stems)}:{v}@{pick(stems)}.svc.example:{rng.randrange(5000, 6000)}/{pick(stems)}"
            out.append((styled(pick(["database_url", "dsn", "broker", "conexion", "queue"]), url), v))
        elif kind == 6:
            v = secrets["named"]()
            out.append((styled(pick(["callback", "hook_url", "access_code", "webhook"]), f"https://{pick(stems)}.example/hook?token={v}"), v))
        elif kind == 7:
            v = basic()
            out.append((styled(pick(["authorization", "proxy_auth", "auth_header"]), f"{pick(['Basic', 'basic'])} {v}"), v))
        elif kind == 8:
            v = password() if rng.random() < 0.7 else secrets["named"]()
            out.append((pick([f"# old password was {v}", f"-- temporary login: admin / {v}", f"/* the password is {v} */", f"// login: root / {v}", f"curl -s -u {pick(stems)}:{v} https://{pick(stems)}.example/health", f'client = connect("{pick(stems)}.example", user="{pick(stems)}", passwd="{v}")']), v))
        elif kind == 9:
            v = rand(pick([32, 40, 64]), "0123456789abcdef") if rng.random() < 0.7 else "-".join(rand(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))
            out.append((styled(pick(plain), v), None))
        elif kind == 10:
            out.append((styled(pick(good_pass + good_key), pick(hold)), None))
        elif kind == 11:
            out.append((styled(pick(meta), pick(["access_token1", "user_pwd_2", "password1x", *calm])), None))
        elif kind == 12:
            out.append((styled(pick(neutral + stems), pick(calm)), None))
        elif kind == 13:
            v = rand(rng.randrange(40, 300), alnum + "+/")
            out.append((pick([f'pixel = "data:image/gif;base64,{v}"', f'"integrity": "sha512-{v}=="', f'  "{v}",', v, f"# {v}", styled(pick(["blob", "payload", "glyphs", "page"]), v)]), None))
        elif kind == 14:
            out.append((pick([f"public int {pick(stems)}{rand(3)}4(java.util.List<Integer> {pick(stems)}s12345) {{", f"for (int i{rand(8)}1 = 0; i < {rng.randrange(9**9)}; i++)", f"import {pick(stems)}_{pick(stems)}_v22.{pick(stems)}", f"# see {pick(stems)}/{pick(stems)}-2024-11-02.md for details"]), None))
        elif kind == 15:
            body = "\n".join(rand(64, alnum + "+/") for _ in range(5))
            name = pick(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "PUBLIC KEY", "CERTIFICATE"])
            block = f"-----BEGIN {name}-----\n{body}\n-----END {name}-----"
            mark = pick(["", "", "# ", "-- ", "    ", "// "])
            shown = "\n".join(mark + x for x in block.split("\n"))[len(mark) :] if rng.random() < 0.8 else block.replace("\n", "\\n")
            line = mark + shown if mark or rng.random() < 0.3 else styled("pem", shown)
            if rng.random() < 0.15:
                line, name = f"# header looks like -----BEGIN {name}----- and so on", "PUBLIC"
            out.append((line, shown if "PRIVATE" in name else None))
        else:
            v = "-".join(rand(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))
            out.append((styled(pick(["user_id", "session_id", "doc_id", "trace", "node", "id"]), v), None))
    return out


def plain_lines(count: int = 2400, seed: int = 7, placed: bool = False) -> list[tuple[str, str | None]]:
    """Composed lines of credentials that are short or have no digit, and of such words that are none; ``placed``: of values whose place says what they are, and of addresses."""
    rng = random.Random(seed)
    pick = rng.choice
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    rand = lambda n, a=letters: "".join(pick(a) for _ in range(n))
    types = ["string", "str", "async", "function", "number", "None", "null", "true", "false", "await", "self", "any", "new", "bool", "Optional"]
    words = ["owner", "kind", "render_record", "splitCursor", "label", "page", "status", "Password", "password", "token", "login", "user", "email", "text", "id", "x", "es", "utf", "sortByName", "MAX_SIZE", "keep", "revisar", "admin", "Submit"]
    hold = ["changeme", "YOUR_API_KEY_HERE", "REPLACE_ME", "********", "xxxx", "placeholder", "your-password", "example", "TODO", "dummy", "none", "redacted"]

    def lone(word: bool = True) -> str:
        a, b = pick(_STEMS), pick(_STEMS)
        shapes = [a + pick("._-") + b.capitalize() + pick("*!#&"), a.capitalize() + pick("*!#&") + b, rand(rng.randrange(10, 22)), rand(rng.randrange(4, 7)) + str(rng.randrange(10)), a[:4] + str(rng.randrange(10, 100))]
        return pick(shapes + [a, a + b, a + b.capitalize()] * word)

    def name(names: list[str]) -> str:
        n = pick(names)
        n = pick([n, n, n.upper(), n.split("_")[0] + "".join(p.capitalize() for p in n.split("_")[1:])])
        return n + pick(["", "", "", "_" + rand(3, letters[26:]), "_" + rand(3, letters[:26]), rand(2)])

    def quoted(n: str, v: str) -> str:
        return pick([
            f'{n} = "{v}"', f"const {n} = '{v}';", f'  "{n}": "{v}",', f'  {n}: "{v}"', f'export {n}="{v}"', f'    private static final String {n} = "{v}";', f"INSERT INTO settings (name, value) VALUES ('{n}', '{v}');", f'  <meta name="{n}" content="{v}">',
            f"def open_page(retries=2, {n}='{v}'):", f"{n}: `{v}`", f"{n}='{v}'", f"connect(user='admin', {n}='{v}')", f'open_page("{pick(_STEMS)}.example", {n}="{v}")',
        ])

    def bare(n: str, v: str) -> str:
        return pick([f"/* {n}: {v} */", f"# {n} = {v}", f"mysql://{pick(['app', 'root'])}:{v}@db.example:3306/x", f'  "dsn": "amqp://{pick(_STEMS)}:{v}@{pick(_STEMS)}.example:5000/{pick(_STEMS)}",', f"curl -s -u {pick(_STEMS)}:{v} https://{pick(_STEMS)}.example", f"<{n}>{v}</{n}>", f"{n}={v}", f"{n}: {v}"])

    def told(v: str) -> str:
        return pick([f"# old password was {v}", f"-- temporary login: admin / {v}", f"/* use token {v} until the move */", f"// the password is {v}", f"Authorization: Bearer {v}", f"<!-- user {pick(_STEMS)}, clave {v} -->"])

    def none() -> str:
        n, w, a = name(_GOOD_PASS + _GOOD_KEY), pick(words + _STEMS), pick(_STEMS)
        return pick([
            f"{n}: {pick(types)},", f"const {n} = {pick(types)} (row) => {{", f"{n} = {pick(types)}", f"{n} = {a}.{n}", f"{n} = get_{n}({w})", f"const {n} = process.env.{n.upper()};", f'{n} = os.environ["{n.upper()}"]', f'"{n}": "{n}",', f"{n} = {w}.{a}", f"{n}={n}, {a}={w}",
            f"return this.{pick(['token', 'secret', 'key'])}.filter((k) => k !== '{w}');", f'{w}_list = ["token", "{w}", "{a}"]', f"TOKEN_{w.upper()}_{rand(3).upper()} = _msg.Field(name='{w}', number=4, type=5)", f'  "token_{w}_{rand(3).lower()}": {{"{a}s": [8, 9], "note": "{w} the order stable"}}',
            f'<input type="password" name="{w}" placeholder="{w}">', f'if {n} == "{w}":', f'"{n}": "",', f'{n} = "{pick(hold)}"', quoted(n, pick(hold)), f"  {n}: <{a}>", f'key = "{w}"', f'"key": "{w}", "code": "{w}"', f'label: "{w}", token: "{w}"',
            f"the {pick(['password', 'token', 'secret', 'login'])} {pick(['is', 'was'])} {pick(['not', 'read', 'checked', 'empty', 'wrong', 'stored', 'avoided'])}", f"# the token of the {a} is {pick(['read', 'kept', a])} by the {w}", quoted(pick(_META), w), f"{a}Key: '{w}'", f'throw new Error("{n} {w}")', f"print('{n}: {w}')",
            f"export const {n} = ({w}: {pick(types)}): {pick(types)} => {{", f"export function filter{a.capitalize()}(tokens: any[], limit: number = 26): any[] {{", f"    const basic {w}", f"  basic {w} and token {a}", f"const {n} = '{{{{ {n} }}}}';", f'{n} = "${{{n.upper()}}}"', f'{n} = "%{n.upper()}%"',
        ])

    def placed_value() -> tuple[str, str]:
        """A value whose place alone says what it is."""
        a, b, n = pick(_STEMS), pick(_STEMS), name(_GOOD_PASS)
        v = pick([a + b, a + b + pick(_STEMS), a + b.capitalize(), a.capitalize() + pick("@!#") + str(rng.randrange(10, 9999)), lone(word=False)])
        bare_url = v if "@" not in v and "#" not in v else a + b
        return pick([
            (f"{pick(['redis', 'postgres', 'mongodb', 'mongodb+srv', 'amqp', 'mysql', 'https'])}://{pick([a, 'app', 'admin', 'root', 'svc'])}:{bare_url}@{b}.{pick(['internal', 'example.org', 'svc'])}{pick(['', ':6379', '/0', '/main?x=1'])}", bare_url), (f"CREATE ROLE {a} LOGIN PASSWORD '{v}';", v), (f"SET PASSWORD FOR {a} = '{v}';", v), (f"GRANT ALL ON {a}.* TO {b} IDENTIFIED BY '{v}';", v),
            (f'config.set("{n}", "{v}")', v), (f"put('{n}', '{v}')", v), (f'env.{n.upper()} = "{v}"', v), (f"ARG {n.upper()}={v}", v), (f"{n.upper()} {v if any(c.isdigit() for c in v) else v + '7'}", v if any(c.isdigit() for c in v) else v + "7"), (quoted(name(["session_secret", "cookie_secret", "jwt_secret", "hmac_secret", "app_secret"]), v), v), (f"{n}: {v}" if not v.isalpha() else f'{n}: "{v}"', v),
        ])

    def address() -> str:
        a, b = pick(_STEMS), pick(_STEMS)
        mail = f"{a}.{b}@{pick(_STEMS)}.{pick(['example', 'org', 'com'])}"
        mark = rand(rng.randrange(8, 15), letters + "0123456789")
        if rng.random() < 0.5:
            # Marks of rows, which no name calls a secret.
            return pick([f"INSERT INTO {a} VALUES ({rng.randrange(99)}, '{b}', {rng.randrange(99999)}, '{mark}');", f"({rng.randrange(99)}, '{a}', '{mark}'),", f'["{mark}", "{a}"]', f"{a} = '{mark}'", f'  "{b}": "{mark}",', f'<td id="{mark}">', f"const {mark[0]}{rng.randrange(99)}={rng.randrange(999)},{mark[1]}{rng.randrange(99)}='{a}';", f"{mark[0]}{rng.randrange(99)} = '{a}'", f'var {mark[:2]}="{b}",{mark[2]}=1', f"{a}Kind='{b}'"])
        return pick([f'email = "{mail}"', f"  user: '{mail}',", f"// contact {mail}", f'login("{mail}")', f'"username": "{mail}"', f"password_reset_mail = '{mail}'", f"git@{a}.example:{b}/repo.git", f"npm i @{a}/{b}@1.2.3", f'"{a}@{rng.randrange(9)}"', f"@{a}('{b}')", f"scp {a}@{b} .", f"uses: {a}/{b}@v{rng.randrange(9)}", f"key={a}@{b}, n=3"])

    def calm() -> str:
        v = "".join(pick(_STEMS).capitalize() for _ in range(rng.randrange(2, 5)))
        v = pick([v, v[0].lower() + v[1:], v[0].lower() + v[1:] + rand(3).capitalize(), "_".join(pick(_STEMS) for _ in range(3)), "-".join(pick(_STEMS) for _ in range(3)), pick(_STEMS), "/".join(pick(_STEMS) for _ in range(3)), rand(rng.randrange(2, 6)) + str(rng.randrange(10)), "x" + str(rng.randrange(100))])
        return pick([
            f"export function {v}(rows, limit) {{", quoted(pick(_NEUTRAL + _STEMS + _META), v), f"  {v}() {{", f"    public int {v}(java.util.List<Integer> rows) {{", f'title = "{v} and {pick(_STEMS)}"', f"import {v}", f"  {pick(_STEMS)}: {v},", f"{pick(_GOOD_KEY)}s = {v}({pick(_STEMS)})",
            f"INSERT INTO {pick(_STEMS)} VALUES ({rng.randrange(100)}, '{pick(_STEMS)}', {rng.randrange(9999)}, '{v}');", f"<li>{v}</li>", f".{pick(['key', 'token', 'node', pick(_STEMS)])}-{pick(_STEMS)}-{rand(3).lower()}{{margin:{rng.randrange(99)}px;color:#{rand(3, 'abcdef0123456789')}}}" * 3, f"cut -d {v} --{pick(_STEMS)} {v}", f"# this is how {pick(_STEMS)} is {v}", f'["{v}", "{v}"]', f"  \"{pick(['sha', 'commit', 'data', 'font'])}\": \"{rand(rng.randrange(12, 60))}\",", f'pixel = "data:image/gif;base64,{rand(rng.randrange(16, 90), letters + "+/")}"',
        ])

    out: list[tuple[str, str | None]] = []
    while len(out) < count:
        kind = 8 + rng.randrange(2) if placed else rng.randrange(8)
        drawn = rand(rng.randrange(16, 44))
        if kind == 0:
            out.append((pick([quoted(name(_GOOD_KEY + _GOOD_PASS + _NEUTRAL), drawn), told(drawn), bare(name(_GOOD_KEY), drawn), f"https://{pick(_STEMS)}.example/hook?token={drawn}"]), drawn))
        elif kind == 1:
            v = lone()
            out.append((quoted(name(_GOOD_PASS), v), v))
        elif kind == 2:
            v = lone(word=False)
            out.append((pick([bare(name(_GOOD_PASS), v), told(v)]), v))
        elif kind <= 5:
            out.append((none(), None))
        elif kind == 8:
            out.append(placed_value())
        elif kind == 9:
            out.append((address(), None))
        else:
            out.append((calm(), None))
    return out


@lru_cache(maxsize=1)
def trained_field() -> Field:
    lines = []
    for text, secret in training_lines() + plain_lines(3000) + plain_lines(600, 9, placed=True):
        tokens = tokens_of(text)
        rows = features(tokens, text)
        at = text.find(secret) if secret else -1
        end = at + len(secret) if secret else -1
        gold = [int(secret is not None and rows[i] is not None and t.start < end and t.end > at) for i, t in enumerate(tokens)]
        if any(r is not None for r in rows):
            lines.append((rows, gold))
    return Field().fit(lines)


# ---- application -----------------------------------------------------------

#: Part of every line that can hold a credential: a token that stands out, one of DRAWN_LENGTH, a name that speaks for one, or a user's part of an address.
_HINTS = "|".join(sorted({w[:4] for w in PASS | SECRET if len(w) > 3} | {w for w in PASS | SECRET if len(w) <= 3}))
_QUICK = re.compile(
    r"-----BEGIN|(?=[^\s\"'`()\[\]{}<>,;:=?@|\\]{8})[^\s\"'`()\[\]{}<>,;:=?@|\\]*?\d|[^\s\"'`()\[\]{}<>,;:=?@|\\]{16}|://[^\s/]*@|(?:-u|--user)[ =]|" + rf"(?i:{_HINTS})"
)


def find_spans(text: str, field: Field, remembered: dict | None = None) -> list[tuple[int, int]]:
    """Character spans of the credentials of a whole text."""
    spans: list[tuple[int, int]] = []
    at, n = 0, len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        if "-----BEGIN" in line:
            block = re.compile(_PEM, re.S).search(text, at)
            if block and block.start() <= end:
                tail = text.find("\n", block.end())
                end = n if tail < 0 else tail
                line = text[at:end]
        last = at
        while end < n and _FOLLOWS.match(text, end + 1) and _GOES_ON.match(text, max(text.rfind(q, last, end) for q in "\"'`"), end):
            last = end + 1
            tail = text.find("\n", end + 1)
            end = n if tail < 0 else tail
        line = text[at:end]
        found = remembered.get(line) if remembered is not None else None
        if found is None:
            found = []
            if _QUICK.search(line):
                tokens = tokens_of(line)
                rows = features(tokens, line)
                if any(r is not None for r in rows):
                    labels = field.viterbi(rows)
                    found = [(t.start, t.end) for t, label in zip(tokens, labels) if label]
            if remembered is not None and len(line) < 400:
                if len(remembered) > MAX_REMEMBERED:
                    remembered.clear()
                remembered[line] = found
        if found:
            spans += [(at + a, at + b) for a, b in found]
        at = end + 1
    return spans


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the credentials' characters masked, of equal length and lines.

    Of a key block only the encoded body is masked, so escapes, comment marks
    and the frame stay as they are; masks are letters, which no quoting breaks.
    """
    out, last = [], 0
    for a, b in spans:
        value = text[a:b]
        if value.startswith("-----BEGIN"):
            body = re.sub(r"(-----[A-Z0-9 ]+-----)|(?<=\\n)[A-Za-z0-9+/=]+|(?<!\\)[A-Za-z0-9+/=]{8,}|(?<=\\n)[A-Za-z0-9+/=]+", lambda m: m[1] or "X" * len(m[0]), value)
            masked = body
        elif _JOIN.search(value):
            joins = [m.span() for m in _JOIN.finditer(value)]
            masked = "".join(c if any(i <= k < j for i, j in joins) else "X" for k, c in enumerate(value))
        else:
            masked = "X" * len(value)
        out += [text[last:a], masked]
        last = b
    return "".join([*out, text[last:]])


#: Lines whose spans a worker keeps between its tasks.
MAX_REMEMBERED = 250_000


@lru_cache(maxsize=1)
def _remembered() -> dict[str, list[tuple[int, int]]]:
    return {}


FOUND = "text_key string, line_no int, start int, stop int, redacted string"


def scan(texts: DataFrame) -> DataFrame:
    """One row per credential of each distinct text (columns text, text_key)."""
    field = trained_field()
    shared = texts.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, remembered = shared.value, _remembered()
        for batch in batches:
            rows = []
            for key, text in zip(batch["text_key"], batch["text"]):
                spans = find_spans(text, model, remembered)
                if spans:
                    safe = redact(text, spans)
                    rows += [(key, text.count("\n", 0, a) + 1, a, b, safe if i == 0 else None) for i, (a, b) in enumerate(spans)]
            if rows:
                yield pd.DataFrame(rows, columns=["text_key", "line_no", "start", "stop", "redacted"])

    return texts.select("text_key", "text").mapInPandas(run, FOUND)


def _sources(files: DataFrame, chunks: DataFrame) -> DataFrame:
    def rows(df: DataFrame, origin: str, key: Column, text: str) -> DataFrame:
        return df.where(F.col(text).isNotNull()).select(
            F.lit(origin).alias("origin"), F.col("generation_id").cast("int").alias("generation_id"), key.alias("record_key"), F.col(text).alias("text")
        )

    return rows(files, "files", F.col("path"), "text").unionByName(rows(chunks, "chunks", F.col("id"), "content"))


def credentials(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """origin, generation_id, record_key, line_no, start, stop, redacted of each credential.

    Each distinct text is scanned once; the narrow result is joined back.
    """
    rows = _sources(files, chunks).withColumn("text_key", F.sha2("text", 256))
    hot, salt = hot_keys(rows, "text_key"), ("generation_id", "record_key")
    found = scan(distinct_texts(rows, "text", salt=salt, hot=hot))
    if hot:
        found = found.dropDuplicates(["text_key", "start"])
    return spread_join(rows.drop("text").distinct(), found, ["text_key"], "inner", hot, salt).drop("text_key")
