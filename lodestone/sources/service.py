"""The operations of the block service, by name: what each asks for, single calls, and calls for rows of a table.

Lists go through ``rest.pages`` (all pages); what reads or changes one thing is a request whose
path has the ids in braces. ``plan`` turns rows into requests, which ``rest.send`` sends or
``answers`` sends and returns. A request may be sent twice when a task is lost, so ``answers``
of operations that create something belong into a table that is written once.
"""

from __future__ import annotations

import json
import mimetypes
import os
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import rest

#: Operations, their methods and paths, and the fields of their bodies (a star: required).
OPERATIONS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "get_block": ("GET", "blocks/{block_id}", ()),
    "append_block_children": ("PATCH", "blocks/{block_id}/children", ("children*", "position")),
    "update_block": ("PATCH", "blocks/{block_id}", ("block*",)),
    "delete_block": ("DELETE", "blocks/{block_id}", ()),
    "get_page": ("GET", "pages/{page_id}", ()),
    "create_page": ("POST", "pages", ("parent*", "properties*", "children")),
    "update_page": ("PATCH", "pages/{page_id}", ("properties", "in_trash")),
    "move_page": ("PATCH", "pages/{page_id}", ("parent*",)),
    "duplicate_page": ("POST", "pages/{page_id}/duplicate", ()),
    "get_page_property": ("GET", "pages/{page_id}/properties/{property_id}", ()),
    "get_database": ("GET", "databases/{database_id}", ()),
    "create_database": ("POST", "databases", ("parent*", "title*", "properties*")),
    "update_database": ("PATCH", "databases/{database_id}", ("title", "properties")),
    "get_data_source": ("GET", "data_sources/{data_source_id}", ()),
    "create_comment": ("POST", "comments", ("parent*", "rich_text*")),
    "get_me": ("GET", "users/me", ()),
    "get_user": ("GET", "users/{user_id}", ()),
    "get_view": ("GET", "views/{view_id}", ()),
    "update_view": ("PATCH", "views/{view_id}", ("name", "type_config")),
    "delete_view": ("DELETE", "views/{view_id}", ()),
    "create_webhook": ("POST", "webhooks", ("url*", "events*")),
    "delete_webhook": ("DELETE", "webhooks/{webhook_id}", ()),
    "create_file_upload": ("POST", "files/upload", ("name*", "content_type*")),
    "complete_file_upload": ("POST", "files/upload/{file_upload_id}/complete", ()),
}
#: Lists, their methods and paths.
LISTS = {
    "search": ("POST", "search"),
    "query_database": ("POST", "databases/{database_id}/query"),
    "query_data_source": ("POST", "data_sources/{data_source_id}/query"),
    "list_data_sources": ("GET", "data_sources"),
    "get_block_children": ("GET", "blocks/{block_id}/children"),
    "list_users": ("GET", "users"),
    "list_comments": ("GET", "comments?block_id={block_id}"),
    "list_webhooks": ("GET", "webhooks"),
}
#: Where things lie that go to the trash, and those that only go for good.
COLLECTIONS = {"page": "pages", "block": "blocks", "view": "views", "webhook": "webhooks"}
SOFT = ("page", "block")

_ID = re.compile(r"\{(\w+)\}")


def prepared(operation: str, **values) -> tuple[str, str, str | None]:
    """(method, path, body) of an operation; ids and required fields must be given, other fields may."""
    method, path, fields = OPERATIONS[operation]
    ids = _ID.findall(path)
    names = {f.rstrip("*") for f in fields}
    missing = [x for x in (*ids, *(f[:-1] for f in fields if f.endswith("*"))) if values.get(x) is None]
    unknown = sorted(set(values) - names - set(ids))
    if missing or unknown:
        raise ValueError(f"{operation}: " + "; ".join(f"{what} {', '.join(v)}" for what, v in (("needs", missing), ("has no", unknown)) if v))
    body = {k: v for k, v in values.items() if k in names and v is not None}
    if names == {"block"}:
        body = body["block"]
    return method, path.format(**{k: values[k] for k in ids}), json.dumps(body) if fields else None


@dataclass(frozen=True)
class Client:
    """Single calls, from the driver or a task."""

    url: str
    token: str = ""
    wait: float = rest.WAIT

    def call(self, operation: str, **values) -> dict:
        method, path, body = prepared(operation, **values)
        return self.send(method, path, body)

    def send(self, method: str, path: str, body: str | None = None) -> dict:
        return rest.request(f"{self.url.rstrip('/')}/{path}", method, body, self.token, wait=self.wait)

    def trash(self, kind: str, id_: str) -> dict:
        """Pages and blocks go to the trash, views and webhooks for good."""
        if kind in SOFT:
            return self.send("PATCH", f"{COLLECTIONS[kind]}/{id_}", json.dumps({"in_trash": True}))
        return self.delete_permanently(kind, id_)

    def restore(self, kind: str, id_: str) -> dict:
        if kind not in SOFT:
            raise ValueError(f"a {kind} can't be restored")
        return self.send("PATCH", f"{COLLECTIONS[kind]}/{id_}", json.dumps({"in_trash": False}))

    def delete_permanently(self, kind: str, id_: str) -> dict:
        return self.send("DELETE", f"{COLLECTIONS[kind]}/{id_}")

    def upload_bytes(self, upload_url: str, content: bytes) -> None:
        head = {"Content-Type": "application/octet-stream"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urllib.request.urlopen(urllib.request.Request(upload_url, content, head, method="PUT"), timeout=60) as r:
            r.read()

    def upload_file(self, path: str, content_type: str | None = None) -> dict:
        """Announces a file, sends its bytes and completes the upload; the answer of the last step."""
        kind = content_type or mimetypes.guess_type(path)[0] or "application/octet-stream"
        begun = self.call("create_file_upload", name=os.path.basename(path), content_type=kind)
        with open(path, "rb") as f:
            self.upload_bytes(begun["upload_url"], f.read())
        return self.call("complete_file_upload", file_upload_id=begun["id"])


def listed(spark: SparkSession, url: str, operation: str, ids: list[dict] | None = None, body: dict | None = None, children: bool = False, **options) -> DataFrame:
    """path, page, item of every page of a list, for each of the ids side by side."""
    method, path = LISTS[operation]
    paths = [path.format(**i) for i in ids or [{}]]
    return rest.pages(spark, url, paths, method=method, body=json.dumps(body or {}), children=str(children).lower(), **options)


def page_blocks(spark: SparkSession, url: str, page_id: str, **options) -> DataFrame:
    """A page and all blocks below it: path, page, item; the page itself has the path of its own."""
    blocks = listed(spark, url, "get_block_children", [{"block_id": page_id}], children=True, **options)
    own = spark.createDataFrame([(f"pages/{page_id}",)], "path string").select(F.lit("GET").alias("method"), "path", F.lit(None).cast("string").alias("body"))
    head = answers(own, url, **{k: v for k, v in options.items() if k in ("token", "wait")})
    return head.select("path", F.lit(0).alias("page"), F.col("answer").alias("item")).unionByName(blocks)


def plan(rows: DataFrame, operation: str, **values: Column) -> DataFrame:
    """method, path, body of an operation for every row; ids are columns of text, fields columns of any type."""
    method, path, fields = OPERATIONS[operation]
    names = [f.rstrip("*") for f in fields]
    missing = [x for x in (*_ID.findall(path), *(f[:-1] for f in fields if f.endswith("*"))) if x not in values]
    if missing:
        raise ValueError(f"{operation}: needs {', '.join(missing)}")
    parts, at = [], 0
    for m in _ID.finditer(path):
        parts += [F.lit(path[at : m.start()]), values[m[1]].cast("string")]
        at = m.end()
    given = [values[n].alias(n) for n in names if n in values]
    body = F.to_json(values["block"]) if names == ["block"] else F.to_json(F.struct(*given)) if given else F.lit("{}") if fields else F.lit(None).cast("string")
    return rows.select(F.lit(method).alias("method"), F.concat(*parts, F.lit(path[at:])).alias("path"), body.alias("body"))


def answers(requests: DataFrame, url: str, token: str = "", wait: float = rest.WAIT) -> DataFrame:
    """path, answer (JSON) of requests (method, path, body), sent one by one in each task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(url, token, float(wait))
        for batch in batches:
            got = [json.dumps(client.send(r["method"], r["path"], r["body"]), sort_keys=True) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.string())], names=["path", "answer"])

    return requests.select("method", "path", "body").mapInArrow(go, "path string, answer string")


# --- schemas ---


def store_body(parent: dict, title: str, properties: dict[str, str | dict]) -> dict:
    """The body that creates a database: one property alone has to be the title."""
    if sum(p == "title" or isinstance(p, dict) and "title" in p for p in properties.values()) != 1:
        raise ValueError("exactly one property has to be the title")
    return {"parent": parent, "title": [{"type": "text", "text": {"content": title}}], "properties": {k: v if isinstance(v, dict) else {v: {}} for k, v in properties.items()}}


def json_schema(properties: dict[str, dict], required: list[str] = ()) -> dict:
    """An object's JSON schema; what is required has to be a property."""
    lost = sorted(set(required) - set(properties))
    if lost:
        raise ValueError(f"no such properties: {', '.join(lost)}")
    return {"type": "object", "properties": dict(properties), "required": list(required)}


def page_title(properties: Column, file_name: Column) -> Column:
    """The title of a map of properties, or the name of its file without the ending."""
    from lodestone.functions import names

    return F.coalesce(F.nullif(F.trim(F.try_element_at(properties, F.lit("title"))), F.lit("")), names.stem(file_name))


def embeddings(answer: Column) -> Column:
    """Vectors of an embedding service's answer, in the order of their index."""
    data = F.from_json(answer, "data array<struct<index:int,embedding:array<float>>>").data
    return F.transform(F.array_sort(data, lambda a, b: F.when(a.index < b.index, -1).when(a.index > b.index, 1).otherwise(0)), lambda d: d.embedding)


def relevances(answer: Column) -> Column:
    """(index, score) of a reranker's answer, best first."""
    data = F.from_json(answer, "results array<struct<index:int,relevance_score:double>>").results
    return F.array_sort(data, lambda a, b: F.when(a.relevance_score > b.relevance_score, -1).when(a.relevance_score < b.relevance_score, 1).otherwise(0))


def embed(texts: DataFrame, url: str, model: str, token: str = "", batch: int = 64) -> DataFrame:
    """doc, embedding of (doc, text) by an embedding service, batch texts a request."""
    kind = texts.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(url, token)
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                data = client.send("POST", "embeddings", json.dumps({"model": model, "input": [t or "" for t in part.column(1).to_pylist()]}))["data"]
                if len(data) != part.num_rows:
                    raise ValueError(f"{len(data)} vectors for {part.num_rows} texts")
                vectors = [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["doc", "embedding"])

    return texts.select("doc", "text").mapInArrow(go, f"doc {kind}, embedding array<float>")


def provider(config: dict[str, str] | None = None, defaults: dict[str, str] | None = None, environment: dict[str, str] | None = None, prefix: str = "LODESTONE_") -> dict[str, str]:
    """url, embedding_model and rerank_model: the environment's before the configuration's before the defaults."""
    env = os.environ if environment is None else environment
    found = {}
    for key in ("url", "embedding_model", "rerank_model"):
        value = env.get(prefix + key.upper()) or (config or {}).get(key) or (defaults or {}).get(key) or ""
        if not value.strip():
            raise ValueError(f"no {key}")
        found[key] = value.strip()
    if not re.match(r"https?://[^/]", found["url"]):
        raise ValueError(f"not an http address: {found['url']}")
    return found
