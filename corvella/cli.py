"""Command line: index, freshness, stats, retrieve, search-image, ingest, chunk, rewrite, summary,
embed, rerank, doctor, status. Errors are JSON on stderr."""

from __future__ import annotations

import argparse
import json
import sys

from . import config
from .indexer import Indexer, Locked
from .operators.chunk import document_chunks
from .providers import HashingEmbedder, HttpChat, HttpEmbedder, HttpImageEmbedder, HttpReranker, HttpVision, health, reachable, rewrite, summarise
from .sources.parse import kind_of, parse_one

# Error codes, and what mends them.
CODES = {
    "E_DEPENDENCY_MISSING": "install the missing package",
    "E_CONNECTION_REFUSED": "start the model service",
    "E_DIMENSION_MISMATCH": "use the table's model, or a new table",
    "E_UNKNOWN_KB": "register the knowledge base",
    "E_INVALID_ARGS": "see --help",
    "E_INTERNAL_ERROR": "report the message",
    "E_INDEX_LOCKED": "wait for the other run",
    "E_FILE_PARSE_ERROR": "check the file",
    "E_EMBEDDING_FAILED": "check the embedding service",
    "E_RERANK_FAILED": "use --no-rerank",
    "E_CONFIG_INVALID": "mend the registry",
}
OK, ERROR, WARNING, INTERRUPTED = 0, 1, 2, 130
NEED_KB = ("index", "freshness", "stats", "retrieve", "search-image")


class UsageError(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise UsageError(message)


def code_of(e: BaseException) -> str:
    """An error's code, by its type."""
    kinds = (
        (config.UnknownKB, "E_UNKNOWN_KB"),
        (config.BadConfig, "E_CONFIG_INVALID"),
        (Locked, "E_INDEX_LOCKED"),
        (ImportError, "E_DEPENDENCY_MISSING"),
        (ConnectionError, "E_CONNECTION_REFUSED"),
        (UsageError, "E_INVALID_ARGS"),
        (FileNotFoundError, "E_FILE_PARSE_ERROR"),
    )
    return next((c for k, c in kinds if isinstance(e, k)), "E_DIMENSION_MISMATCH" if "dimension" in str(e) else "E_INVALID_ARGS" if isinstance(e, ValueError) else "E_INTERNAL_ERROR")


def parser() -> Parser:
    top = Parser(prog="corvella")
    for p in (top,):
        p.add_argument("--registry", default="registry.yaml")
        p.add_argument("--db", default="./corvella-db")
        p.add_argument("--kb")
        p.add_argument("--json", action="store_true", dest="json_before")
    sub = top.add_subparsers(dest="command", required=True, parser_class=Parser)

    def command(name: str, *args, **flags):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        for k, v in flags.items():
            p.add_argument("--" + k.replace("_", "-"), **(v if isinstance(v, dict) else {"default": v, "type": type(v)}))
        p.add_argument("--json", action="store_true")
        return p

    on = {"action": "store_true"}
    command("index", force=on, no_prune=on)
    command("freshness")
    command("stats")
    command("retrieve", "query", top_k=8, mode={"choices": ["hybrid", "semantic", "keyword"], "default": "hybrid"}, no_rerank=on, path_filter={}, trace={}, explain=on, rewrite=on, expand=on, context="")
    command("search-image", "image", top_k=5, path_filter={})
    command("ingest", "path")
    command("chunk", "file", max_chars=800)
    command("rewrite", "query", context="")
    command("summary", "file", title="")
    command("embed", "text", model="")
    command("rerank", "query", docs={"nargs": "+", "required": True}, top_k=5)
    command("doctor")
    command("status")
    return top


def embedder(kb: config.KBConfig, services: Services | None = None):
    url = kb.extra.get("embed_url") or (services.urls.get("embed") if services else None)
    return HttpEmbedder(url, kb.embed_model, kb.dimensions) if url else HashingEmbedder(kb.dimensions)


def image_embedder(kb: config.KBConfig):
    url = kb.extra.get("image_url")
    return HttpImageEmbedder(url, kb.extra.get("image_model", ""), int(kb.extra.get("image_dimensions", 2048))) if url else None


def content(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, "rb") as f:
        made = parse_one(path, f.read())
    if made["doc_type"] == "error":
        raise FileNotFoundError(made["content"])
    return made["content"]


def run(args, spark=None) -> tuple[object, int]:
    """A command's result and exit code."""
    from .session import session

    name = args.command
    if name in NEED_KB and not args.kb:
        raise UsageError(f"{name} needs --kb")
    if name == "ingest":
        with open(args.path, "rb") as f:
            return parse_one(args.path, f.read()), OK
    if name == "chunk":
        return [vars(c) for c in document_chunks(content(args.file), kind_of(args.file) if args.file != "-" else "text", args.max_chars)], OK
    services = Services.of(args.registry)
    if name == "rewrite":
        return rewrite(args.query, services.chat(), args.context, services.prompts), OK
    if name == "summary":
        return summarise(content(args.file), services.chat(), args.title, prompts=services.prompts), OK
    if name == "embed":
        return services.embedder(args.model).embed([args.text])[0], OK
    if name == "rerank":
        scores = services.rerank_scores(args.query, args.docs)
        rated = sorted(((s, -i) for i, s in enumerate(scores)), reverse=True)
        return [{"index": -i, "score": round(s, 6)} for s, i in rated[: args.top_k]], OK
    if name == "doctor":
        return doctor(args, services, spark)
    if name == "status":
        found = health(services.calls())
        return {"services": found}, OK if all(found.values()) else WARNING
    kbs, performance = config.load(args.registry)
    spark = spark or session("local[*]")
    if name == "retrieve" and args.kb == "all":
        from pyspark.sql import functions as F

        from .operators.fusion import union_corpora

        parts = {n: retrieved(spark, kb, args, services, performance) for n, kb in kbs.items() if kb.type != "multimodal"}
        return [r.asDict(recursive=True) for r in union_corpora(parts, args.top_k, [F.desc("score"), F.col("kb"), F.col("path"), F.col("chunk_id")]).collect()], OK
    kb = config.pick(kbs, args.kb)
    if name == "search-image":
        from .operators.knn import nearest

        made = image_embedder(kb)
        if made is None:
            raise config.BadConfig(f"{kb.name}: no image_url")
        (vector,) = made.embed([args.image])
        images = Indexer(spark, kb, args.db, embedder(kb, services), image_embedder=made).images.near(vector)
        return [r.asDict(recursive=True) for r in nearest(images, vector, args.top_k, path_filter=args.path_filter, ties=("path", "image_id")).collect()], OK
    if name == "retrieve":
        if args.trace:
            rows = retriever(spark, kb, args, services).trace(args.query, top_k=args.top_k, mode=args.mode, use_rerank=not args.no_rerank)
            rows.toPandas().to_html(args.trace)
        rows = retrieved(spark, kb, args, services, performance)
        return [r.asDict(recursive=True) for r in rows.orderBy("rank").collect()], OK
    see = HttpVision(kb.extra["vision_url"], kb.extra.get("vision_model", "")) if kb.extra.get("vision_url") else services.vision()
    indexer = Indexer(spark, kb, args.db, embedder(kb, services), see=see, image_embedder=image_embedder(kb), performance=performance)
    if name == "index":
        report = indexer.index(force=args.force, prune=not args.no_prune)
        return report, WARNING if report["files_failed"] else OK
    if name == "freshness":
        found = indexer.freshness()
        return found, OK if found["is_fresh"] else WARNING
    return indexer.store.stats(), OK


def retriever(spark, kb, args, services):
    from .retriever import Retriever

    url = kb.extra.get("rerank_url") or services.urls.get("rerank")
    model = kb.extra.get("rerank_model") or services.models.get("rerank", "")
    how = {"score": lambda q, t: HttpReranker(url, model).column(q, t)} if url else {}
    made = embedder(kb, services)
    return Retriever(Indexer(spark, kb, args.db, made).store, made, chat=services.chat(), prompts=services.prompts, **how)


def retrieved(spark, kb, args, services, performance):
    from pyspark.sql import functions as F

    rows = retriever(spark, kb, args, services).retrieve(
        args.query,
        mode=args.mode,
        top_k=args.top_k or performance["top_k"],
        recall_size=performance["rerank_recall_size"],
        use_rerank=not args.no_rerank,
        path_filter=args.path_filter,
        use_rewrite=args.rewrite,
        expand=args.expand,
        context=args.context,
    )
    keep = ["rank", "path", "chunk_id", "text", "score", "ranked_by", "source", "section_title", "heading_path"]
    return rows.select(*keep, *(["explain"] if args.explain else [F.lit(None).cast("map<string,string>").alias("explain")]))


class Services:
    """The model services that the registry's `services` names, each with url and model; where it names
    none, the deterministic stand-ins serve."""

    def __init__(self, given: dict | None = None):
        given = given or {}
        parts = {k: v for k, v in given.items() if isinstance(v, dict)}
        self.urls = {k: v["url"] for k, v in parts.items() if v.get("url")}
        self.models = {k: v.get("model", "") for k, v in parts.items()}
        self.dims = {k: int(v.get("dimensions", 64)) for k, v in parts.items()}
        self.prompts = given.get("prompts")

    @classmethod
    def of(cls, registry: str) -> Services:
        try:
            return cls(config.services(registry))
        except (config.BadConfig, ImportError):
            return cls()

    def chat(self):
        return HttpChat(self.urls["chat"], self.models["chat"]) if "chat" in self.urls else None

    def vision(self):
        return HttpVision(self.urls["vision"], self.models["vision"]) if "vision" in self.urls else None

    def embedder(self, model: str = ""):
        if "embed" not in self.urls:
            return HashingEmbedder(self.dims.get("embed", 64))
        return HttpEmbedder(self.urls["embed"], model or self.models["embed"], self.dims["embed"])

    def rerank_scores(self, query: str, docs: list[str]) -> list[float]:
        if "rerank" in self.urls:
            return HttpReranker(self.urls["rerank"], self.models["rerank"]).scores(query, docs)
        from .operators.rerank import similarity

        return [similarity(query, d) for d in docs]

    def calls(self) -> dict:
        """A small request to each service that is named."""
        calls = {
            "embed": lambda: self.embedder().embed(["ping"]),
            "rerank": lambda: self.rerank_scores("ping", ["ping"]),
            "chat": lambda: self.chat().complete("ping"),
            "vision": lambda: reachable(self.urls["vision"]),
        }
        return {k: v for k, v in calls.items() if k in self.urls}


def doctor(args, services, spark=None) -> tuple[dict, int]:
    """Dependencies, disk, registry, services, an embedding, and each table's statistics: what is there,
    and 0, 2 for warnings or 1 for errors."""
    import importlib.util
    import shutil

    deps = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy", "yaml", "pypdf", "fitz", "PIL")}
    free = shutil.disk_usage(".").free
    try:
        kbs, bad = config.load(args.registry)[0], None
    except config.BadConfig as e:
        kbs, bad = {}, str(e)
    missing = [m for m in ("pyspark", "pyarrow", "pandas", "numpy") if not deps[m]]
    found = health(services.calls())
    try:
        dim, embeds = len(services.embedder().embed(["ping"])[0]), None
    except Exception as e:
        dim, embeds = None, f"{type(e).__name__}: {e}"
    tables = {}
    if kbs:
        from .session import session
        from .store import open_store

        spark = spark or session("local[*]")
        for n, kb in kbs.items():
            store = open_store(spark, f"{args.db}/kb_{n}", backend=kb.vector_backend, dim=kb.dimensions)
            tables[n] = store.stats() if store.version() else None
    warn = [
        *([f"{free >> 30} GB free"] if free < 10 << 30 else []),
        *([f"registry: {bad}"] if bad else []),
        *(f"service {k} does not answer" for k, ok in found.items() if not ok),
        *([f"embedding: {embeds}"] if embeds else []),
    ]
    report = {"dependencies": deps, "free_bytes": free, "knowledge_bases": list(kbs), "services": found, "embedding_dimensions": dim, "tables": tables, "errors": missing, "warnings": warn}
    return report, ERROR if missing else WARNING if warn else OK


def main(argv: list[str] | None = None, spark=None) -> int:
    command = kb = ""
    try:
        args = parser().parse_args(argv)
        command, kb = args.command, args.kb or ""
        result, status = run(args, spark)
        print(json.dumps(result, ensure_ascii=False, indent=None if args.json or args.json_before else 2, default=str))
        return status
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception as e:  # every failure has a code
        code = code_of(e)
        print(json.dumps({"error": {"code": code, "message": str(e), "command": command, "kb": kb, "fix": CODES[code]}}, ensure_ascii=False), file=sys.stderr)
        return WARNING if isinstance(e, UsageError) else ERROR


if __name__ == "__main__":
    sys.exit(main())
