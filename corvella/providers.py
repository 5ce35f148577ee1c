"""Embedding, reranking and text generation: HTTP services, and deterministic stand-ins.

The stand-ins make the engine testable without a model; they make no claim of quality.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands before a query that is embedded with an instruction.
INSTRUCTION = "Instruct: Retrieve relevant passages that answer the question.\nQuery: "
BATCH, TRIES, FIRST_WAIT, LONGEST_WAIT, TIMEOUT = 64, 5, 2.0, 30.0, 180.0


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_column(provider: Embedder, text: str, batch: int = BATCH) -> Column:
    """A provider as a column: batches of Arrow rows, null texts null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        there = texts[texts.notna()]
        for i in range(0, len(there), batch):
            part = there.iloc[i : i + batch]
            for k, v in zip(part.index, provider.embed(part.tolist()), strict=True):
                out[k] = np.asarray(v, dtype=np.float32)
        return out

    return run(text)


class HashingEmbedder:
    """Signed hashes of lower-cased character trigrams, as a unit vector."""

    def __init__(self, dim: int = 64, n: int = 3):
        self.dim, self.n = dim, n

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t.lower()) for t in texts]

    def _one(self, t: str) -> list[float]:
        v = [0.0] * self.dim
        for i in range(max(1, len(t) - self.n + 1)):
            h = int(hashlib.md5(t[i : i + self.n].encode()).hexdigest()[:8], 16)
            v[h % self.dim] += 1.0 if (h // self.dim) % 2 == 0 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v

    def column(self, text: Column) -> Column:
        """The same, in Catalyst: what a plan without Python needs. What is used more than once is bound
        first, as an expression in a lambda is evaluated for each element."""

        def bound(value: Column, use: Callable[[Column], Column]) -> Column:
            return F.element_at(F.transform(F.array(value), use), 1)

        def hashed(low: Column) -> Column:
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (self.n - 1))), lambda i: F.substr(low, i, F.lit(self.n)))
            return F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"))

        def sums(hashes: Column) -> Column:
            sign = lambda h: F.when(F.floor(h / self.dim) % 2 == 0, 1.0).otherwise(-1.0)
            return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda d: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.when(h % self.dim == d, sign(h)).otherwise(0.0)))

        def unit(v: Column) -> Column:
            norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
            return bound(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))

        return bound(bound(bound(F.lower(text), hashed), sums), unit)


def post_json(url: str, body: dict, *, timeout: float = TIMEOUT, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, opener=urllib.request.urlopen) -> dict:
    """POST with retries on lost connections, timeouts, 429 and 5xx; waits double, with jitter."""
    wait = FIRST_WAIT
    for left in range(tries - 1, -1, -1):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with opener(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise RuntimeError(f"{url}: HTTP {e.code}") from e
            last: Exception = e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            last = e
        if left:
            sleep(min(wait, LONGEST_WAIT) * (1 + 0.3 * random.random()))
            wait *= 2
    raise RuntimeError(f"{url}: no answer in {tries} tries: {last}")


class HttpEmbedder:
    def __init__(self, url: str, model: str, dim: int):
        self.url, self.model, self.dim = url, model, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), BATCH):
            got = post_json(self.url, {"model": self.model, "input": texts[i : i + BATCH]})["data"]
            out += [r["embedding"] for r in sorted(got, key=lambda r: r["index"])]
        if any(len(v) != self.dim for v in out):
            raise ValueError(f"the service's vectors don't have {self.dim} components")
        return out


def data_url(image, longest: int = 1152) -> str:
    """An image (path, bytes, base64 text or data URL) as a data URL; with an image library, of at
    most `longest` pixels on an edge."""
    import base64
    import mimetypes

    if isinstance(image, str) and image.startswith("data:"):
        return image
    kind = None
    if isinstance(image, str) and os.path.exists(image):
        kind = mimetypes.guess_type(image)[0]
        with open(image, "rb") as f:
            raw = f.read()
    else:
        raw = base64.b64decode(image, validate=True) if isinstance(image, str) else bytes(image)
    try:
        from PIL import Image  # optional

        with Image.open(io.BytesIO(raw)) as picture:
            if max(picture.size) > longest:
                picture.thumbnail((longest, longest))
                out = io.BytesIO()
                picture.convert("RGB").save(out, format="PNG")
                raw, kind = out.getvalue(), "image/png"
    except ImportError:
        pass
    if kind is None:
        marks = {b"\x89PNG": "image/png", b"\xff\xd8": "image/jpeg", b"GIF8": "image/gif", b"RIFF": "image/webp"}
        kind = next((k for m, k in marks.items() if raw.startswith(m)), "application/octet-stream")
    return f"data:{kind};base64,{base64.b64encode(raw).decode()}"


class HttpImageEmbedder(HttpEmbedder):
    """Images (paths, bytes, base64 or data URLs) as data URLs; one that fails is a zero vector."""

    def embed(self, texts: list) -> list[list[float]]:
        out = []
        for t in texts:
            try:
                out += super().embed([data_url(t)]) if t else [[0.0] * self.dim]
            except (RuntimeError, ValueError, OSError):
                out.append([0.0] * self.dim)
        return out


class HttpVision:
    """Reads images by a chat service that sees: text and description, or text alone.

    Answers are remembered by image and prompt, failures (an empty text) too.
    """

    def __init__(self, url: str, model: str, prompt: str = "", tries: int = 3):
        self.url, self.model, self.prompt, self.tries = url, model, prompt or SEE, tries
        self.known: dict[tuple[str, str], str] = {}

    def __call__(self, image, page: int | None = None, prompt: str | None = None) -> str:
        ask = prompt or self.prompt
        url = data_url(image)
        key = (hashlib.sha256(url.encode()).hexdigest(), ask)
        if key not in self.known:
            message = {"role": "user", "content": [{"type": "text", "text": ask}, {"type": "image_url", "image_url": {"url": url}}]}
            try:
                got = post_json(self.url, {"model": self.model, "messages": [message], "temperature": 0}, tries=self.tries)
                self.known[key] = str(got["choices"][0]["message"]["content"]).strip()
            except (RuntimeError, KeyError, IndexError):
                self.known[key] = ""
        return self.known[key]

    def ocr(self, image) -> str:
        return self(image, prompt=OCR)


SEE = "Describe this image: all text in it, what it shows, and what kind of image it is."
OCR = "Give all text in this image, in order and in its layout, and nothing else."


class HttpReranker:
    def __init__(self, url: str, model: str):
        self.url, self.model = url, model

    def scores(self, query: str, texts: list[str]) -> list[float]:
        if not query.strip() or not texts:
            return []
        got = post_json(self.url, {"model": self.model, "query": query, "documents": texts})["results"]
        by = {r["index"]: round(float(r["relevance_score"]), 6) for r in got}
        return [by[i] for i in range(len(texts))]

    def column(self, query: str, text: str) -> Column:
        """Scores of a query column against a text column; null where the service fails."""

        @F.pandas_udf("double")
        def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(texts), index=texts.index, dtype="float64")
            for q, at in queries.groupby(queries).groups.items():
                try:
                    out[at] = self.scores(q, texts[at].tolist())
                except (RuntimeError, KeyError):
                    pass
            return out

        return run(query, text)


class Chat(Protocol):
    def complete(self, prompt: str) -> str: ...


class HttpChat:
    def __init__(self, url: str, model: str, tries: int = 3):
        self.url, self.model, self.tries = url, model, tries

    def complete(self, prompt: str) -> str:
        got = post_json(self.url, {"model": self.model, "messages": [{"role": "user", "content": prompt}]}, tries=self.tries)
        return got["choices"][0]["message"]["content"]


def _json_of(answer: str) -> dict:
    import re

    return json.loads(re.sub(r"^\s*```(?:json)?|```\s*$", "", answer.strip()))


#: What a model is asked, unless a file says otherwise: the part for the system, and for the user.
PROMPTS = {
    "query-rewrite": ("", "Rewrite the search query as JSON with rewritten, keywords, sub_queries.\nContext: {context}\nQuery: {query}"),
    "document-summary": ("", "Summarise as JSON with title, summary, tags, key_entities, content_type, language.\nTitle: {title}\n\n{text}"),
    "image": ("", SEE),
}


def prompt(name: str, folder: str | None = None) -> tuple[str, str]:
    """A prompt's parts for system and user: of <folder>/<name>-prompt.md, whose user part follows a line
    `## user` and whose headings are left out of the system part; else of PROMPTS."""
    at = os.path.join(folder, f"{name}-prompt.md") if folder else ""
    if not at or not os.path.exists(at):
        return PROMPTS.get(name, ("", ""))
    with open(at, encoding="utf-8") as f:
        system, _, user = f.read().partition("## user")
    return "\n".join(line for line in system.splitlines() if not line.startswith("#")).strip(), user.strip()


def asked(name: str, folder: str | None, **values: str) -> str:
    """A prompt with its places filled in."""
    text = "\n\n".join(p for p in prompt(name, folder) if p)
    for k, v in values.items():
        text = text.replace("{" + k + "}", v)
    return text


def rewrite(query: str, chat: Chat | None, context: str = "", prompts: str | None = None) -> dict:
    """rewritten, keywords, sub_queries; without an answer the query itself and its words."""
    plain = {"rewritten": query, "keywords": [w for w in query.split() if len(w) >= 2], "sub_queries": []}
    if chat is None:
        return plain
    try:
        return plain | {k: v for k, v in _json_of(chat.complete(asked("query-rewrite", prompts, context=context, query=query))).items() if k in plain}
    except Exception:  # a model's failure leaves the query as it is
        return plain


REWRITTEN = "struct<rewritten:string,keywords:array<string>,sub_queries:array<string>>"


def rewrite_column(query: str, chat: Chat | None, prompts: str | None = None) -> Column:
    """`rewrite` of a column of queries."""

    @F.pandas_udf(REWRITTEN)
    def run(queries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewrite(q, chat, "", prompts) for q in queries], columns=["rewritten", "keywords", "sub_queries"])

    return run(query)


def expansion_column(query: Column, made: Column, most: int = 2) -> Column:
    """`expansions` of columns of queries and of what `rewrite` made of them."""
    subs = F.filter(F.transform(made["sub_queries"], lambda s: F.trim(s)), lambda s: (s != "") & (s != query))
    return F.concat(F.array(query), F.slice(subs, 1, most))


def expansions(query: str, made: dict, most: int = 2) -> list[str]:
    """The query, and up to `most` sub-queries that differ from it."""
    subs = [s.strip() for s in made["sub_queries"] if s and s.strip() and s.strip() != query]
    return [query, *subs[:most]]


SUMMARY = "struct<title:string,summary:string,tags:array<string>,key_entities:array<string>,content_type:string,language:string>"


def summarise(text: str, chat: Chat | None, title: str = "", most: int = 4000, prompts: str | None = None) -> dict:
    plain = {"title": title, "summary": "", "tags": [], "key_entities": [], "content_type": "unknown", "language": "unknown"}
    if chat is None:
        return plain
    body = text if len(text) <= most else text[:most] + "\n...[truncated]"
    try:
        return plain | {k: v for k, v in _json_of(chat.complete(asked("document-summary", prompts, title=title, text=body))).items() if k in plain}
    except Exception:
        return plain


def summary_column(text: str, title: str, chat: Chat | None, prompts: str | None = None) -> Column:
    """`summarise` of columns of texts and titles."""

    @F.pandas_udf(SUMMARY)
    def run(texts: pd.Series, titles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summarise(x or "", chat, t or "", prompts=prompts) for x, t in zip(texts, titles, strict=True)])

    return run(text, title)


def reachable(url: str, timeout: float = 5.0) -> None:
    """An error if nothing answers there; any HTTP answer will do."""
    try:
        urllib.request.urlopen(url, timeout=timeout).close()
    except urllib.error.HTTPError:
        pass


def health(services: dict[str, Callable[[], object]]) -> dict[str, bool]:
    """Whether each service answers."""
    out = {}
    for name, call in services.items():
        try:
            call()
            out[name] = True
        except Exception:
            out[name] = False
    return out
