"""The query tools: named arguments in, a markdown report out. Lookups are lazy; only a report's rows reach the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.qname import PREFIXES, last_segment, parse_qname
from lodestone.operators import catalog, graph, prose, vector
from lodestone.plans import render

TOOLS = ("search", "section", "parts", "element", "type", "children", "attributes", "enum", "namespace", "package_part", "preset_shape")
#: JSON-RPC codes of what can go wrong with a call.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603


class ToolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Engine:
    """Tables and injectable parts: `embed` turns a query into a vector, `record` is told of each successful call; a section report holds `page_rows` rows."""

    spark: SparkSession
    graph: dict[str, DataFrame] = field(default_factory=dict)
    content: DataFrame | None = None
    embed: Callable[[str], list[float] | DataFrame] = lambda text: vector.embed_text(text).tolist()
    record: Callable[[Row], None] | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    prefixes: dict[str, str] = field(default_factory=lambda: PREFIXES)
    profile: str = "transitional"
    page_rows: int = 50

    def call(self, name: str, args: dict | None = None, user: str = "", client: str = "", surface: str = "api") -> str:
        """Run one tool. A recorder that fails does not lose the result; failed calls are not recorded."""
        if not isinstance(name, str) or not name:
            raise ToolError(INVALID_PARAMS, "a tool name is needed")
        if name not in TOOLS:
            raise ToolError(METHOD_NOT_FOUND, f"no such tool: {name}")
        out = getattr(self, "_" + name)({k: v for k, v in (args or {}).items() if v is not None})
        if self.record:
            try:
                self.record(Row(user_id=user, client_id=client, tool=name, surface=surface, occurred_at=self.clock()))
            except Exception:  # noqa: BLE001  the report matters more than the log
                logging.getLogger(__name__).warning("usage was not recorded", exc_info=True)
        return out

    # Prose

    def _need(self, args: dict, key: str) -> str:
        value = args.get(key)
        if not isinstance(value, str) or not value.strip():
            raise ToolError(INVALID_PARAMS, f"argument {key} is needed")
        return value

    def _part(self, args: dict) -> int | None:
        part = args.get("part")
        if part is not None and not isinstance(part, int):
            raise ToolError(INVALID_PARAMS, "part must be a whole number")
        return part

    def _search(self, args: dict) -> str:
        query = self._need(args, "query")
        found = vector.search(self.content, self.embed(query), vector.clamp_limit(args.get("limit")), part=self._part(args))
        return render.search_results(query, found.collect())

    def _section(self, args: dict) -> str:
        """A page of rows at a time: a short prefix or a wildcard can match the whole table."""
        wanted, after = self._need(args, "section_id"), args.get("after")
        if after is not None and not (isinstance(after, str) and after.rpartition("#")[2].isdecimal()):
            raise ToolError(INVALID_PARAMS, "after must be the mark that the page before ended with")
        rows = prose.section_page(self.content, wanted, self.page_rows + 1, self._part(args), after).collect()
        more = f"{rows[-2]['section_id']}#{rows[-2]['id']}" if len(rows) > self.page_rows else None
        return render.section_results(wanted, rows[: self.page_rows], more)

    def _parts(self, args: dict) -> str:
        part = self._part(args)
        found = prose.top_per_part(prose.listing(self.content, part)).orderBy("part_number", "place")
        return render.part_listing(found.collect(), part)

    # The symbol graph

    def _qname(self, args: dict) -> Row:
        raw = str(args.get("qname", ""))
        return self.spark.range(1).select(parse_qname(F.lit(raw), self.prefixes).alias("q")).first()["q"]

    def _named(self, df: DataFrame, q: Row) -> Row | None:
        return df.where((F.col("namespace_uri") == q["namespace"]) & (F.col("local_name") == q["local_name"])).orderBy("id").first()

    def _local(self, q: Row, profile: str) -> list[Row]:
        found = graph.local_elements(self.graph, profile).where((F.col("namespace_uri") == q["namespace"]) & (F.col("local_name") == q["local_name"]))
        return found.orderBy("owner_kind", "owner_name", "id").collect()

    def _owner(self, q: Row, profile: str, groups: bool = False) -> Row:
        asked = self.spark.createDataFrame([(q["namespace"], q["local_name"])], "namespace_uri string, local_name string")
        return graph.owners(self.graph, profile, asked, groups).first()

    def _missing(self, what: str, q: Row, profile: str, kind: str | None = None) -> str:
        others = graph.elsewhere(self.graph, profile, q["local_name"], kind).collect()
        return render.not_found(f"{what} {q['local_name']} in {q['namespace']}", profile, others)

    def _element(self, args: dict) -> str:
        q, profile = self._qname(args), args.get("profile", self.profile)
        if not q["ok"]:
            return render.not_found(f"the name cannot be read: {q['reason']}")
        outcome = self._owner(q, profile)["element_outcome"]
        if outcome == "declared":
            return render.symbol("Element", self._named(graph.elements(self.graph, profile), q), profile)
        if outcome == "single":
            return render.local_element(q["local_name"], self._local(q, profile), profile)
        if outcome == "ambiguous":
            return render.ambiguous(q["local_name"], self._local(q, profile))
        return self._missing("element", q, profile, "element")

    def _type(self, args: dict) -> str:
        q, profile = self._qname(args), args.get("profile", self.profile)
        if not q["ok"]:
            return render.not_found(f"the name cannot be read: {q['reason']}")
        hit = self._named(graph.types(self.graph, profile), q)
        if not hit:
            return self._missing("type", q, profile)
        return render.symbol("Simple type" if hit["kind"] == "simpleType" else "Complex type", hit, profile)

    def _of_type(self, args: dict, what: str, groups: bool, find: Callable, show: Callable) -> str:
        q, profile = self._qname(args), args.get("profile", self.profile)
        if not q["ok"]:
            return render.not_found(f"the name cannot be read: {q['reason']}")
        answer = self._owner(q, profile, groups)
        if answer["outcome"] == "ambiguous":
            return render.ambiguous(q["local_name"], self._local(q, profile))
        if answer["outcome"] == "none":
            return self._missing(f"{what} of", q, profile)
        notes = {"element": f"Element `{q['local_name']}` has this type.\n\n", "local": f"Resolved from the local element `{q['local_name']}`.\n\n"}
        root = self.graph["symbols"].where(F.col("id") == answer["owner_id"])
        return show(root.first(), find(self.graph, profile, root).orderBy("ordinal").collect(), notes.get(answer["via"], ""))

    def _children(self, args: dict) -> str:
        return self._of_type(args, "children", True, graph.content_model, render.children)

    def _attributes(self, args: dict) -> str:
        return self._of_type(args, "attributes", False, graph.attributes, render.attributes)

    def _enum(self, args: dict) -> str:
        q, profile = self._qname(args), args.get("profile", self.profile)
        if not q["ok"]:
            return render.not_found(f"the name cannot be read: {q['reason']}")
        hit = self._named(graph.types(self.graph, profile), q)
        if not hit or hit["kind"] != "simpleType":
            return self._missing("simpleType", q, profile, "simpleType")
        return render.enums(hit, graph.enums(self.graph, profile).where(F.col("symbol_id") == hit["id"]).orderBy("ordinal").collect())

    def _namespace(self, args: dict) -> str:
        uri, query = (str(args.get(k, "")).strip() for k in ("uri", "query"))
        if uri:
            rows = graph.namespaces(self.graph, uri=uri).collect()
            if rows:
                return render.namespaces(f"Namespace `{uri}`", rows)
            part = self.spark.range(1).select(last_segment(F.lit(uri))).first()[0]
            rows = graph.namespaces(self.graph, query=part).orderBy("uri").collect() if part else []
            note = f"Namespaces that hold '{part}':\n\n" if rows else ""
            return render.namespaces(f"No namespace is `{uri}`", rows, note)
        rows = graph.namespaces(self.graph, query=query or None).orderBy("uri").collect()
        return render.namespaces(f"Namespaces with '{query}'" if query else "Namespaces", rows)

    # Catalogs

    def _package_part(self, args: dict) -> str:
        kind, relation, query = (str(args.get(k, "")).strip() for k in ("content_type", "relationship_type", "query"))
        every = catalog.parts(self.spark)
        if kind:
            hit = catalog.by_content_type(every, kind).first()
            return render.package_part(hit) if hit else render.not_found(f"a part of content type {kind}")
        if relation:
            hits = catalog.by_relationship(every, relation).orderBy("ordinal").collect()
            if not hits:
                return render.not_found(f"a part with relationship {relation}")
            footer = "\n\nSeveral kinds of package share this relationship; the part it starts from tells them apart."
            return render.package_part(hits[0]) if len(hits) == 1 else render.package_parts(f"Parts with relationship `{relation}`", hits, footer)
        return render.package_parts(f"Parts with '{query}'" if query else "Package parts", catalog.search(every, query).collect())

    def _preset_shape(self, args: dict) -> str:
        name = str(args.get("shape", "")).strip()
        return render.shape(name, catalog.shape_guides(catalog.shapes(self.spark), name))


def rpc(engine: Engine, request: object) -> dict:
    """A JSON-RPC answer to a request already parsed: initialize, tools/list, tools/call."""
    call_id = request.get("id") if isinstance(request, dict) else None
    answer = lambda **x: {"jsonrpc": "2.0", "id": call_id, **x}
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or "method" not in request:
        return answer(error={"code": INVALID_REQUEST, "message": "not a JSON-RPC 2.0 request"})
    params = request.get("params") or {}
    if request["method"] == "initialize":
        return answer(result={"capabilities": {"tools": {}}})
    if request["method"] == "tools/list":
        return answer(result={"tools": [{"name": x} for x in TOOLS]})
    if request["method"] != "tools/call":
        return answer(error={"code": METHOD_NOT_FOUND, "message": f"no such method: {request['method']}"})
    try:
        text = engine.call(params.get("name"), params.get("arguments"))
    except ToolError as error:
        return answer(error={"code": error.code, "message": str(error)})
    except Exception as error:  # noqa: BLE001  the caller gets a message instead of a stack
        return answer(error={"code": INTERNAL_ERROR, "message": f"the tool failed: {error}"})
    return answer(result={"content": [{"type": "text", "text": text}]})
