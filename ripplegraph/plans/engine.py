"""The analysis: entries to call graph, resources, edges and warnings, for all entries in one job."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.model import FACTS, QUEUE_TYPES, Options
from ripplegraph.operators import extractors, joins, resources
from ripplegraph.operators.mentions import mentions, whole_and_untagged
from ripplegraph.operators.symbols import Facts, accessors, dispatch, first_methods, methods, qualifiers
from ripplegraph.plans.reach import INFERRED_MARK, depth_first, reach
from ripplegraph.sources import batch as batch_inputs
from ripplegraph.storage import matching, materialize

log = logging.getLogger(__name__)
CHUNK = 10  # rows of a job between two reports of progress


def facts_of(spark: SparkSession, given: dict[str, DataFrame | list]) -> Facts:
    """All fact tables; those that aren't given are empty."""
    out = {}
    for name, schema in FACTS.items():
        rows = given.get(name, [])
        out[name] = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    return out


@dataclass
class Result:
    """All by ``root_id``: entries, methods, edges, resources, warnings."""

    entries: DataFrame
    methods: DataFrame
    edges: DataFrame
    resources: DataFrame
    warnings: DataFrame


@dataclass
class Engine:
    """An analysis of one set of facts. ``extra`` extractors run after the built-in ones."""

    facts: Facts
    options: Options = field(default_factory=Options)
    extra: list = field(default_factory=list)

    def __post_init__(self) -> None:
        f, o = self.facts, self.options
        self.spark = f["method"].sparkSession
        m = methods(f)
        shown = ~text.starts_with_any(F.coalesce("class_fqn", F.lit("")), list(o.excluded_prefixes))
        if o.only_project_source:
            shown = shown & F.coalesce("is_project_source", F.lit(False))
        self.methods = materialize(m.select("project", "method_key", "class_fqn", "name", "label", "is_project_source", "is_abstract", "ord", shown.alias("shown")), "methods")
        self.contexts = extractors.contexts(f, o)
        self.extracted, self.failures = extractors.run([*extractors.EXTRACTORS, *self.extra], self.contexts)
        self._steps()

    def _steps(self) -> None:
        """Edges of the graph, and the steps of the walk: from a method to what its calls may run."""
        f, o = self.facts, self.options
        known, self.unresolved = resolved_calls(f)
        shown = self.methods.filter("shown").select("method_key")
        kept = known.join(shown.withColumnRenamed("method_key", "callee_key"), "callee_key", "left_semi")
        if o.hide_accessors:
            kept = kept.join(accessors(f).withColumnRenamed("method_key", "callee_key"), "callee_key", "left_anti")
        kept = materialize(kept.join(qualifiers(f), "qualifier_symbol", "left").select("caller_key", "callee_key", "qualifier", "kind", "ord"), "calls")
        to = materialize(dispatch(f, shown, o.follow_overrides), "dispatch")
        direct = kept.select(F.col("caller_key").alias("caller"), F.col("callee_key").alias("callee"), F.lit(0).alias("conf_rank"), F.when(F.col("kind") == "ref", "PSI 方法引用 resolve").otherwise("PSI resolve").alias("reason"), "ord")
        meet = kept.join(to, (kept["callee_key"] == to["callee_key"]) & kept["qualifier"].eqNullSafe(to["qualifier"])).drop(to["callee_key"]).drop(to["qualifier"])
        by_dispatch = meet.filter("reason is not null").select(F.col("caller_key").alias("via"), F.col("callee_key").alias("caller"), F.col("target_key").alias("callee"), F.lit(1).alias("conf_rank"), "reason", "ord")
        self.edges = materialize(direct.withColumn("via", F.col("caller")).unionByName(by_dispatch), "edges")
        target = self.methods.filter("shown and is_project_source").select(F.col("method_key").alias("target_key"), "label")
        steps = meet.join(target, "target_key")
        inferred = F.col("reason").isNotNull()
        self.steps = materialize(
            steps.select(F.col("caller_key").alias("src"), F.col("target_key").alias("dst"), inferred.cast("int").alias("conf"), F.when(inferred, F.concat("label", F.lit(INFERRED_MARK))).otherwise(F.col("label")).alias("label"), F.struct(F.col("kind") == "ref", "ord", "target_key").alias("at"))
            .groupBy("src", "dst", "conf", "label")
            .agg(F.min("at").alias("at")),
            "steps",
        )

    # ---- entries -----------------------------------------------------------------------------------

    def endpoints(self) -> DataFrame:
        return endpoints(self.facts)

    def by_path(self, paths: DataFrame) -> DataFrame:
        """(root_id, type, display, http_method, method_key) of entries for ``paths`` (value)."""
        return entries_at(paths, self.endpoints())

    def consumers(self) -> DataFrame:
        """(topic, method_key) of methods that consume."""
        c = self.extracted.filter((F.col("operation") == "CONSUME") & F.col("type").isin(*QUEUE_TYPES))
        return c.join(self.contexts.rows.select("ctx_id", "method_key"), "ctx_id").select(F.col("name").alias("consumed"), "method_key").distinct()

    def by_topic(self, topics: DataFrame, mentions: bool = True) -> DataFrame:
        """Entries for ``topics`` (value): consumers of an equal topic and, with ``mentions``, methods whose text holds the topic."""
        found = joins.match_topics(topics, self.consumers(), "value", "consumed").select("value", "method_key")
        if mentions:
            found = found.unionByName(self._mentions(topics))
        return found.distinct().select(F.col("value").alias("root_id"), F.lit("MQ").alias("type"), F.col("value").alias("display"), F.lit(None).cast("string").alias("http_method"), "method_key")

    def _mentions(self, topics: DataFrame) -> DataFrame:
        """(value, method_key): topics, whole or without their tag, in the texts of methods."""
        texts = first_methods(self.facts).select(F.col("method_key").alias("key"), "text")
        return mentions(texts, whole_and_untagged(topics)).withColumnRenamed("key", "method_key")

    def by_input(self, value: str) -> DataFrame:
        """Entries for what a user types: a path if it begins with a slash, else a topic."""
        asked = self.spark.createDataFrame([(value.strip(),)], "value string")
        return self.by_path(asked) if value.strip().startswith("/") else self.by_topic(asked)

    def by_position(self, points: DataFrame) -> DataFrame:
        """Entries for positions (value, path, at) in source files: the innermost method around each."""
        spans = self.facts["method_span"].select("path", "start", "end", F.col("method_key").alias("_at"))
        inner = joins.enclosing(points, spans, ["path"], "at", "start", "end", "_at").filter("_at is not null")
        k = inner.select("value", F.col("_at").alias("method_key")).distinct().join(self.methods, "method_key")
        return k.select(F.col("value").alias("root_id"), F.lit("METHOD").alias("type"), F.col("label").alias("display"), F.lit(None).cast("string").alias("http_method"), "method_key")

    @staticmethod
    def missing(asked: DataFrame, entries: DataFrame) -> DataFrame:
        """(root_id, message) of inputs (value) without an entry."""
        none = asked.select(F.col("value").alias("root_id")).distinct().join(entries.select("root_id").distinct(), "root_id", "left_anti")
        return none.select("root_id", F.concat(F.lit("未找到入口："), "root_id").alias("message"))

    def by_method(self, keys: DataFrame) -> DataFrame:
        """Entries for method keys (value)."""
        k = keys.join(self.methods, F.col("value") == F.col("method_key"))
        return k.select(F.col("value").alias("root_id"), F.lit("METHOD").alias("type"), F.col("label").alias("display"), F.lit(None).cast("string").alias("http_method"), "method_key")

    # ---- walk --------------------------------------------------------------------------------------

    def analyze(self, entries: DataFrame, options: Options | None = None) -> Result:
        """Walk from all ``entries`` at once, by ``options`` or else the engine's; several methods of one entry are one result."""
        o = options or self.options
        entries = materialize(entries, "entries")
        labels = self.methods.select(F.col("method_key").alias("node"), "label")
        start = entries.select(F.col("root_id").alias("root"), F.col("method_key").alias("node")).join(labels, "node")
        start = start.select("root", "node", F.lit(0).alias("depth"), F.lit(0).alias("conf"), F.array("label").alias("path"))
        seen = materialize(self._walk(o, start), "seen")
        added = []
        links = None
        if o.follow_cross_project:
            links = materialize(self.client_links(o), "links")
            for _ in range(o.max_cross_depth):
                hop = self.hops(seen, links)
                fresh = hop.join(seen.select("root", "node"), ["root", "node"], "left_anti")
                if fresh.isEmpty():
                    break
                added.append(materialize(hop.select("root", F.col("caller"), F.col("node").alias("callee"), "reason"), "hops"))
                seen = self._more(o, seen, fresh.drop("caller", "reason"))
        found = self._collect(o, seen)
        if o.follow_local_consumers:
            made = found.filter((F.col("operation") == "PRODUCE") & F.col("type").isin(*QUEUE_TYPES)).select("root_id", F.col("name").alias("topic")).distinct()
            eaten = materialize(new_consumers(made, self.consumers(), seen).join(labels, "node"), "eaten")
            if not eaten.isEmpty():
                first = start.groupBy("root").agg(F.min("node").alias("caller"), F.min(F.col("path")[0]).alias("_first"))
                eaten = eaten.join(first, "root")
                added.append(eaten.select("root", "caller", F.col("node").alias("callee"), F.concat(F.lit("本地 MQ 消费者："), "topic").alias("reason")))
                path = F.array("_first", F.concat("label", F.lit(INFERRED_MARK)))
                seen = self._more(o, seen, eaten.select("root", "node", F.lit(1).alias("depth"), F.lit(1).alias("conf"), path.alias("path")).distinct())
                found = self._collect(o, seen)
        return self._result(o, entries, seen, found, added, links)

    def _walk(self, o: Options, start: DataFrame) -> DataFrame:
        """What ``start`` reaches within the depth limit, in the order that the options ask for."""
        if o.depth_first:
            return depth_first(self.steps, start, o.max_depth)
        return reach(self.steps, start, o.max_depth, with_path=True)

    def _more(self, o: Options, seen: DataFrame, start: DataFrame) -> DataFrame:
        """``seen`` with what ``start`` reaches beyond it."""
        more = self._walk(o, start.select("root", "node", "depth", "conf", "path"))
        return materialize(seen.unionByName(more.join(seen.select("root", "node"), ["root", "node"], "left_anti")), "seen")

    def client_links(self, o: Options) -> DataFrame:
        """(ctx_id, node of the call, own project, target node or null, label, project, warning or null) of calls to declared clients.

        A link needs a mapped service, an open project other than the caller's that isn't being indexed, and exactly one
        method there for the path; the first of these that is missing is the warning.
        """
        f = self.facts
        mapping = self.spark.createDataFrame(list(o.service_mappings.items()), "name string, target string")
        client = joins.first_mapping(extractors.feign_endpoints(f), mapping, "service", "service_key")
        client = joins.lookup_project(client, f["project"].filter("is_open"), "target")
        ends = self.endpoints().join(self.methods.select("method_key", F.col("project").alias("to"), "label"), "method_key")
        ends = ends.groupBy(F.col("to").alias("project"), "path").agg(F.count("*").alias("n"), F.min("method_key").alias("found"), F.min("label").alias("label"))
        busy = f["project"].select(F.col("name").alias("project"), F.coalesce("is_indexing", F.lit(False)).alias("busy")).dropDuplicates(["project"])
        client = client.join(ends, ["project", "path"], "left").join(busy, "project", "left")
        calls = self.contexts.rows.filter("call_id is not null").select("ctx_id", F.col("method_key").alias("at"), F.col("project").alias("own"), "target_key")
        rows = calls.join(client, "target_key")
        head = F.concat(F.lit("Feign "), F.concat_ws(" ", "service", "verb", "path"), F.lit(" 未续链："))
        told = lambda *parts: F.concat(head, *[F.lit(x) if not x.startswith("$") else F.col(x[1:]) for x in parts])
        warning = (
            F.when(F.col("target").isNull(), told("未配置服务映射"))
            .when(F.col("project").isNull(), told("目标工程未打开（映射：", "$target", "）"))
            .when(F.col("project") == F.col("own"), told("目标工程与当前工程相同"))
            .when(F.col("busy"), told("目标工程 ", "$project", " 正在索引"))
            .when(F.col("n").isNull(), told("目标工程 ", "$project", " 未找到入口"))
            .when(F.col("n") > 1, told("目标工程 ", "$project", " 命中多个入口"))
        )
        return rows.select("at", "own", "project", F.when(warning.isNull(), F.col("found")).alias("node"), "label", head.alias("head"), warning.alias("warning"))

    def hops(self, seen: DataFrame, links: DataFrame) -> DataFrame:
        """(root, caller, node, depth, conf, path, reason): where calls of reached methods go on in another project."""
        good = links.filter("warning is null").select("at", "own", "project", F.col("node").alias("_node"), "label").distinct()
        out = seen.join(good, seen["node"] == good["at"]).drop("node").withColumnRenamed("_node", "node")
        path = F.array_append("path", F.concat("label", F.lit(INFERRED_MARK)))
        reason = F.concat(F.lit("跨工程 Feign："), "own", F.lit(" -> "), "project")
        return out.select("root", F.col("at").alias("caller"), "node", F.lit(0).alias("depth"), F.greatest("conf", F.lit(1)).alias("conf"), path.alias("path"), reason.alias("reason")).distinct()

    def _collect(self, o: Options, seen: DataFrame) -> DataFrame:
        """Resources of all contexts of reached methods below the depth limit, with path and confidence."""
        c = self.contexts.rows.select("ctx_id", F.col("method_key").alias("node"), "call_id", "project", "target_key", F.col("ord").alias("_ord"))
        c = c.join(self.methods.select(F.col("method_key").alias("target_key"), F.col("label").alias("_target")), "target_key")
        at = seen.filter(F.col("depth") < o.max_depth).join(c, "node").join(self.extracted, "ctx_id")
        path = F.when(F.col("call_id").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_target")))
        told = F.concat(F.lit("来源工程："), F.coalesce(text.blank_to_null(F.col("project")), F.lit("未知工程")), F.lit("；调用路径："), text.display_path(path), F.lit("；原始证据："), "detail")
        order = F.struct("depth", "node", "_ord", "rule", "name")
        rows = at.select(F.col("root").alias("root_id"), order.alias("ord"), "type", "name", "operation", F.greatest("conf_rank", "conf").alias("conf_rank"), told.alias("detail"))
        return resources.reclassify(rows, list(o.query_patterns))

    def _result(self, o: Options, entries: DataFrame, seen: DataFrame, found: DataFrame, added: list[DataFrame], links: DataFrame | None) -> Result:
        found = resources.distinct_evidence(found, ("root_id",))
        if o.merge_resources:
            found = resources.merge(found, ("root_id",))
        walked = seen.filter(F.col("depth") < o.max_depth).select("root", "node")
        edges = walked.join(self.edges, F.col("node") == F.col("via")).select(F.col("root").alias("root_id"), "caller", "callee", "conf_rank", "reason", "ord")
        for more in added:
            edges = edges.unionByName(more.select(F.col("root").alias("root_id"), "caller", "callee", F.lit(1).alias("conf_rank"), "reason", F.lit(0).alias("ord")))
        edges = materialize(resources.distinct_edges(edges, ("root_id",)), "result-edges")
        nodes = seen.select(F.col("root").alias("root_id"), F.col("node").alias("method_key"), "depth", "path")
        ends = edges.select("root_id", F.explode(F.array("caller", "callee")).alias("method_key")).distinct()
        nodes = nodes.join(ends, ["root_id", "method_key"], "full")
        nodes = nodes.join(self.methods.select("method_key", "project", "label", "is_project_source"), "method_key")
        deep = seen.filter(F.col("depth") >= o.max_depth).join(self.methods.select(F.col("method_key").alias("node"), "label"), "node")
        warnings = walked.join(self.unresolved, F.col("node") == F.col("caller_key")).select(F.col("root").alias("root_id"), "message")
        warnings = warnings.unionByName(deep.select(F.col("root").alias("root_id"), F.concat(F.lit(f"调用链达到最大深度 {o.max_depth}："), "label").alias("message")))
        if links is not None:
            said = walked.join(links.filter("warning is not null").select(F.col("at").alias("node"), F.col("warning").alias("message")).distinct(), "node")
            warnings = warnings.unionByName(said.select(F.col("root").alias("root_id"), "message"))
            far = self.hops(seen, links).join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", F.col("caller").alias("at"), "node")
            far = far.join(links.select("at", "node", "head"), ["at", "node"])
            warnings = warnings.unionByName(far.select(F.col("root").alias("root_id"), F.concat("head", F.lit(f"达到最大跨工程深度 {o.max_cross_depth}")).alias("message")))
        many = entries.groupBy("root_id").agg(F.countDistinct("method_key").alias("n")).filter("n > 1")
        warnings = warnings.unionByName(many.select("root_id", F.concat(F.lit("同一入口匹配 "), F.col("n").cast("string"), F.lit(" 个方法，已合并全部候选")).alias("message")))
        if self.failures:
            said = F.explode(F.array(*[F.lit(m) for m in self.failures])).alias("message")
            warnings = warnings.unionByName(entries.select("root_id").distinct().select("root_id", said))
        return Result(entries, nodes, edges, found, warnings.distinct())

    # ---- batch -------------------------------------------------------------------------------------

    def batch(self, inputs: DataFrame, options: Options | None = None, progress: Callable[[int, int, str], None] | None = None, stop: threading.Event | None = None, chunk: int = CHUNK, ledger: str | None = None) -> tuple[DataFrame, Result]:
        """(batch rows (idx, input, status, reason, method_key), result) of ``inputs`` (idx, value); no hops to other projects.

        All rows are one job, or ``chunk`` rows a job where ``progress`` (done, all, input) or ``stop`` wants to be heard. A job that
        fails, or takes longer than its rows' limits of seconds together, is done again by halves, so that one bad row among many costs a few
        jobs; alone it is FAILED with its reason. After ``stop`` is set no more jobs begin, and rows that haven't run are left out.

        With a ``ledger``, a folder for one set of facts and options, each job's results are stored there as they are done; a later call takes
        them from there and runs only the rest, so a stopped batch goes on where it was.
        """
        o = replace(options or self.options, follow_cross_project=False)
        if inputs.limit(batch_inputs.MOST_INPUTS + 1).count() > batch_inputs.MOST_INPUTS:
            raise ValueError(f"more than {batch_inputs.MOST_INPUTS} inputs")
        rows, entries = self._batch_rows(inputs)
        asked = [(r["idx"], r["input"], r["status"]) for r in rows.orderBy("idx").collect()]
        size = chunk if progress or stop is not None else len(asked)
        parts, told = self._kept(ledger) if ledger else ([], {})
        failed = [(idx, told[value]) for idx, value, status in asked if status == "SUCCESS" and told.get(value)]
        left = []
        asked = [a for a in asked if a[1] not in told]
        for i in range(0, len(asked), max(size, 1)):
            some = asked[i : i + size]
            if stop is not None and stop.is_set():
                left += [idx for idx, _, _ in some]
                continue
            if progress:
                progress(i, len(asked), some[0][1])
            done, wrong = self._isolated(entries, [(idx, value) for idx, value, status in some if status == "SUCCESS"], o, ledger)
            parts += done
            failed += wrong
        if progress:
            progress(len(asked) - len(left), len(asked), "")
        wrong = self.spark.createDataFrame(failed, "idx int, _why string")
        rows = rows.filter(~F.col("idx").isin(left)).join(wrong, "idx", "left")
        bad = F.col("_why").isNotNull()
        rows = rows.select("idx", "input", F.when(bad, "FAILED").otherwise(F.col("status")).alias("status"), F.coalesce("_why", "reason").alias("reason"), F.when(~bad, F.col("method_key")).alias("method_key"))
        if not parts:
            parts = [self.analyze(entries.limit(0), o)]
        return rows, Result(*[reduce(DataFrame.unionByName, [getattr(p, f.name) for p in parts]) for f in fields(Result)])

    def _isolated(self, entries: DataFrame, asked: list[tuple[int, str]], o: Options, ledger: str | None = None) -> tuple[list[Result], list[tuple[int, str]]]:
        """(results, (idx, reason) of the rows that failed) of some rows, tried together and then by halves."""
        if not asked:
            return [], []
        mine = entries.filter(F.col("root_id").isin([v for _, v in asked]))
        try:
            result = self._timed(lambda: self._held(self.analyze(mine, o)), o.row_timeout_seconds * len(asked))
            if ledger:
                self._keep(ledger, result, [(v, None) for _, v in asked])
            return [result], []
        except TimeoutError:
            reason = f"超过单行超时 {o.row_timeout_seconds} 秒"
        except Exception as error:
            reason = str(error).splitlines()[0] if str(error) else type(error).__name__
        log.warning("%d rows of a batch, from %s on: %s", len(asked), asked[0][1], reason)
        if len(asked) == 1:
            if ledger:
                self._keep(ledger, None, [(asked[0][1], reason)])
            return [], [(asked[0][0], reason)]
        half = len(asked) // 2
        (a, wrong_a), (b, wrong_b) = (self._isolated(entries, some, o, ledger) for some in (asked[:half], asked[half:]))
        return a + b, wrong_a + wrong_b

    def _keep(self, ledger: str, result: Result | None, done: list[tuple[str, str | None]]) -> None:
        """Store results and the rows that they are for; without that list, which is written last, a part doesn't count."""
        at = f"{ledger}/{uuid.uuid4().hex}"
        for f in fields(Result) if result else ():
            getattr(result, f.name).write.parquet(f"{at}/{f.name}")
        self.spark.createDataFrame(done, "input string, why string").write.parquet(f"{at}/done")

    def _kept(self, ledger: str) -> tuple[list[Result], dict[str, str | None]]:
        """(results, reason or null by input) of what a ledger holds."""
        parts, told = [], {}
        for mark in matching(self.spark, f"{ledger}/*/done/_SUCCESS"):
            at = mark.rsplit("/", 2)[0]
            done = {r["input"]: r["why"] for r in self.spark.read.parquet(f"{at}/done").collect()}  # MOST_INPUTS rows at most
            told |= done
            if None in done.values():
                parts.append(Result(*[self.spark.read.parquet(f"{at}/{f.name}") for f in fields(Result)]))
        return parts, told

    @staticmethod
    def _held(result: Result) -> Result:
        """``result`` computed, so that what fails fails here."""
        return Result(*[materialize(getattr(result, f.name), f.name) for f in fields(Result)])

    def _timed(self, work: Callable[[], Result], seconds: int) -> Result:
        """``work``, its Spark jobs cancelled after so many seconds; 0 is no limit."""
        if not seconds:
            return work()
        tag, context = f"row-{uuid.uuid4().hex}", self.spark.sparkContext
        over = threading.Event()

        def cancel() -> None:
            over.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, cancel)
        context.addJobTag(tag)
        timer.start()
        try:
            out = work()
        except Exception as error:
            raise TimeoutError from error if over.is_set() else None
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        if over.is_set():
            raise TimeoutError
        return out

    def _batch_rows(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows by status, entries of those to analyse)."""
        found = self.by_path(inputs)
        counted = found.groupBy(F.col("root_id").alias("value")).agg(F.countDistinct("method_key").alias("n"), F.min("method_key").alias("method_key"))
        m = self.methods.select("method_key", "is_abstract")
        to = dispatch_roots(self.facts, self.methods)
        rows = inputs.join(counted, "value", "left").join(m, "method_key", "left").join(to, "method_key", "left")
        rows = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "_impls": F.coalesce("impls", F.lit(0))})
        reason = (
            F.when(~F.col("value").startswith("/"), "不是 HTTP 路径")
            .when(F.col("n") == 0, "未定位到接口")
            .when(F.col("n") > 1, "定位到多个接口")
            .when(F.col("is_abstract") & (F.col("_impls") == 0), "interface 方法未找到实现")
            .when(F.col("is_abstract") & (F.col("_impls") > 1), "interface 方法存在多个实现")
        )
        run = F.when(F.col("is_abstract"), F.col("impl")).otherwise(F.col("method_key"))
        rows = rows.select("idx", F.col("value").alias("input"), F.when(reason.isNull(), "SUCCESS").otherwise("SKIPPED").alias("status"), reason.alias("reason"), F.when(reason.isNull(), run).alias("method_key"))
        rows = materialize(rows, "batch")
        good = rows.filter("status = 'SUCCESS'").select(F.col("input").alias("root_id"), F.col("method_key").alias("_run")).distinct()
        entries = found.join(good, "root_id").select("root_id", "type", "display", "http_method", F.col("_run").alias("method_key"))
        return rows, materialize(entries, "batch-entries")


def resolved_calls(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(calls and references whose method is known, (caller_key, message) of the others); references to constructors are neither."""
    calls = facts["call_site"].filter("not (kind = 'ref' and ref_name = 'new')")
    known, missing = joins.resolve(calls, facts["method"], "callee_key", "method_key")
    head = F.when(F.col("kind") == "ref", "无法解析方法引用：").otherwise("无法解析调用：")
    return known, missing.select("caller_key", F.concat(head, "text").alias("message"))


def endpoints(facts: Facts) -> DataFrame:
    """(path, verb, method_key) of all mapped methods: the table that paths are joined to."""
    e = extractors.endpoint_mappings(facts)
    return e.select(text.normalize_path(F.col("class_path"), F.col("method_path")).alias("path"), "verb", "method_key")


def entries_at(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Entries for ``paths`` (value) among ``endpoints``: one hash join on the normal path."""
    asked = paths.select("value", text.normalize_path(F.col("value")).alias("path"))
    return asked.join(found, "path").select(F.col("value").alias("root_id"), F.lit("HTTP").alias("type"), F.concat_ws(" ", "verb", "path").alias("display"), F.col("verb").alias("http_method"), "method_key")


def new_consumers(made: DataFrame, consumers: DataFrame, seen: DataFrame) -> DataFrame:
    """(root, topic, node): consumers of the topics ``made`` (root_id, topic) that the root hasn't ``seen`` (root, node)."""
    eaten = joins.match_topics(made, consumers, "topic", "consumed").select(F.col("root_id").alias("root"), "topic", F.col("method_key").alias("node")).distinct()
    return eaten.join(seen.select("root", "node"), ["root", "node"], "left_anti")


def dispatch_roots(facts: Facts, known: DataFrame) -> DataFrame:
    """(method_key, impls, impl): implementations of every abstract method, without an injection to narrow them."""
    asked = known.filter("is_abstract").select(F.col("method_key").alias("callee_key"))
    calls = asked.select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) if x.split()[0] != "callee_key" else F.col("callee_key") for x in FACTS["call_site"].split(", ")])
    to = dispatch({**facts, "call_site": calls}, known.select("method_key"), False).filter("reason is not null")
    return to.groupBy(F.col("callee_key").alias("method_key")).agg(F.count("*").alias("impls"), F.min("target_key").alias("impl"))
