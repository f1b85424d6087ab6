"""Symbols: annotations, constants behind expressions, class hierarchies with type arguments, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.operators import joins
from ripplegraph.plans.reach import COMPACT, closure
from ripplegraph.storage import dealt, materialize, parts_of

Facts = dict[str, DataFrame]
REASONS = {"only": "唯一实现类", "several": "接口存在多个实现", "override": "运行时可能调用覆写方法"}


def attribute(*names: str, attrs: str = "attrs") -> Column:
    """First string of the first of these attributes that an annotation has."""
    return F.coalesce(*[F.try_element_at(F.try_element_at(F.col(attrs), F.lit(n)), F.lit(1)) for n in names])


def annotated(facts: Facts, kind: str, short: str | list[str], value: Column, out: str) -> DataFrame:
    """(target_id, ``out``): ``value`` of the first annotation of that short name on each target."""
    names = [short] if isinstance(short, str) else short
    hit = F.lit(False)
    for n in names:
        hit = hit | (F.col("short_name") == n) | F.col("fqn").endswith(f".{n}")
    rows = facts["annotation"].filter((F.col("target_kind") == kind) & hit)
    return rows.groupBy("target_id").agg(F.min_by(F.struct(value.alias("v")), "ord").alias("s")).select("target_id", F.col("s.v").alias(out))


def configured(names: tuple[str, ...], fqn: Column, short: Column) -> Column:
    """Whether a class or annotation is one of the configured: by full name, short name, or the end of it."""
    out = F.lit(False)
    for n in names:
        out = out | (fqn == n) | (short == n) | fqn.endswith(f".{n}")
    return F.coalesce(out, F.lit(False))


def value_fields(facts: Facts) -> DataFrame:
    """(symbol, placeholder) of fields that configuration is injected into."""
    rows = annotated(facts, "field", "Value", attribute("value"), "placeholder")
    return rows.select(F.col("target_id").alias("symbol"), "placeholder").filter("placeholder is not null")


def expression_values(facts: Facts) -> DataFrame:
    """(expr_id, value): the constant of an expression, or of what its variable holds, however long that chain is.

    Each round follows twice as many steps as the one before, so chains of any length take few rounds. The last open expression of
    a chain is settled in each; what is still open when a round settles none runs in a circle and has no value.
    """
    e, v = facts["expr"].select("expr_id", "const_value", "ref_symbol"), facts["variable"].select(F.col("symbol").alias("ref_symbol"), "init_expr_id")
    parts = parts_of(e)
    p = value_fields(facts).withColumnRenamed("symbol", "ref_symbol")
    plain = e.filter("ref_symbol is null").withColumns({"init_expr_id": F.lit(None).cast("string"), "placeholder": F.lit(None).cast("string")})  # no key that a partition could be full of
    e = dealt(e.filter("ref_symbol is not null"), parts, "ref_symbol")
    e = e.join(dealt(v, parts, "ref_symbol").dropDuplicates(["ref_symbol"]), "ref_symbol", "left").join(p, "ref_symbol", "left")
    e = dealt(e.unionByName(plain), parts, "expr_id").dropDuplicates(["expr_id"])
    e = materialize(e.select("expr_id", F.coalesce("const_value", "placeholder").alias("value"), F.col("init_expr_id").alias("at")), "expr")
    done, left = e.filter("value is not null").select("expr_id", "value"), e.filter("value is null and at is not null")
    n, last = left.count(), None
    while n and n != last:
        known = left.select(F.col("expr_id").alias("at"), F.col("at").alias("_at"), F.lit(None).cast("string").alias("_v")).unionByName(done.select(F.col("expr_id").alias("at"), F.lit(None).cast("string").alias("_at"), F.col("value").alias("_v")))
        nxt = materialize(dealt(left.select("expr_id", "at"), parts, "at").join(dealt(known, parts, "at"), "at").select("expr_id", F.col("_v").alias("value"), F.col("_at").alias("at")), "expr")
        done = done.unionByName(nxt.filter("value is not null").select("expr_id", "value"))
        left = nxt.filter("value is null and at is not null")
        n, last = left.count(), n
    return done


def formatted(template: Column, arguments: Column) -> Column:
    """A template of %s and %% with its arguments; null if there are too few."""
    parts = F.split(F.replace(template, F.lit("%%"), F.lit("\u0001")), "%s")
    filled = F.zip_with(parts, F.slice(arguments, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(arguments) >= F.size(parts) - 1, F.replace(F.array_join(filled, ""), F.lit("\u0001"), F.lit("%")))


def urls(facts: Facts) -> DataFrame:
    """(expr_id, value) of address expressions: constants, local variables, injected fields, concatenations and formats, however deep.

    Operands of a concatenation that aren't known are left out; a format needs all of its arguments. What leads back to
    the expression that it is an operand of isn't known.
    """
    e = facts["expr"].select("expr_id", F.coalesce("kind", F.lit("")).alias("kind"), "operands", "ref_symbol", "const_value").dropDuplicates(["expr_id"])
    v = facts["variable"].filter("kind = 'local'").select(F.col("symbol").alias("ref_symbol"), "init_expr_id").dropDuplicates(["ref_symbol"])
    p = value_fields(facts).withColumnRenamed("symbol", "ref_symbol")
    e = e.join(p, "ref_symbol", "left").join(v, "ref_symbol", "left")
    e = e.withColumn("parts", F.when(F.col("init_expr_id").isNotNull() & F.col("placeholder").isNull(), F.array("init_expr_id")).otherwise(F.col("operands")))
    e = materialize(e.select("expr_id", "kind", F.coalesce("const_value", "placeholder").alias("value"), "parts"), "url")
    open_ = F.col("value").isNull() & F.coalesce(F.size("parts") > 0, F.lit(False))
    known = e.filter(~open_).select("expr_id", "value")
    parts = e.filter(open_).select("expr_id", "kind", F.posexplode("parts").alias("pos", "part"))
    parts = parts.join(e.select(F.col("expr_id").alias("part"), F.lit(True).alias("_is")), "part", "left")
    parts = materialize(parts.select("expr_id", "kind", "pos", F.when(F.col("_is"), F.col("part")).alias("part")), "url")
    if parts.isEmpty():
        return known.filter("value is not null")
    known, ended = _evaluated(parts, known)
    if not ended:  # circles and what leads to them
        left = materialize(parts.join(known, "expr_id", "left_anti"), "url")
        links = left.join(left.select(F.col("expr_id").alias("part")).distinct(), "part", "left_semi").select("expr_id", "part").distinct()
        back = closure(links.select(F.col("expr_id").alias("sub"), F.col("part").alias("super"))).select(F.col("sub").alias("part"), F.col("ancestor").alias("expr_id"))
        cut = links.join(back, ["expr_id", "part"], "left_semi").unionByName(links.filter("expr_id = part")).withColumn("_cut", F.lit(True))
        left = left.join(cut, ["expr_id", "part"], "left").select("expr_id", "kind", "pos", F.when(F.col("_cut").isNull(), F.col("part")).alias("part"))
        known, _ = _evaluated(materialize(left, "url"), known)
    return known.filter("value is not null")


def _evaluated(parts: DataFrame, known: DataFrame) -> tuple[DataFrame, bool]:
    """``known`` (expr_id, value) and what follows from it for expressions of ``parts`` (expr_id, kind, pos, part; no part: not known); whether that is all.

    A round settles expressions all of whose parts are settled. A concatenation of which one part is open is that part's value between
    two texts (``alt`` where it has none); rounds put two such steps into one, so chains of any length take few rounds. Circles stay open; more steps than
    there are expressions aren't put together, so their texts end.
    """
    waiting, n = parts.withColumn("v", F.lit(None).cast("string")), parts.select("expr_id").distinct().count()
    carried, news, found = None, known, [known]
    has, text_of = lambda x: x["part"].isNotNull(), lambda ps: F.array_join(F.array_compact(F.transform(ps, lambda x: x["v"])), "")
    while True:
        hit = news.select(F.col("expr_id").alias("part"), F.col("value").alias("_v"), F.lit(True).alias("_hit"))
        got = waiting.filter("part is not null").join(hit, "part", "left")
        got = got.select("expr_id", "kind", "pos", F.when(F.col("_hit").isNull(), F.col("part")).alias("part"), F.col("_v").alias("v")).unionByName(waiting.filter("part is null"))
        got = got.groupBy("expr_id").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("pos", "part", "v"))).alias("ps"), F.count("part").alias("open"))
        vs, some = F.transform("ps", lambda x: x["v"]), F.exists("ps", lambda x: x["v"].isNotNull())
        fails = (F.col("kind") == "format") & F.exists("ps", lambda x: x["part"].isNull() & x["v"].isNull())
        fmt = F.when(~fails, formatted(vs[0], F.slice(vs, F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0)))))
        state = F.when((F.col("open") == 0) | fails, "settled").when((F.col("open") == 1) & (F.col("kind") != "format"), "carried").otherwise("waiting")
        value = F.when(F.col("kind") == "format", fmt).when(some, text_of(F.col("ps")))
        got = materialize(got.select("expr_id", "kind", "ps", state.alias("state"), value.alias("value")), "url")
        settled = [got.filter("state = 'settled'").select("expr_id", "value")]
        waiting = got.filter("state = 'waiting'").select("expr_id", "kind", F.inline("ps"))
        of = F.filter("ps", has)[0]
        new = got.filter("state = 'carried'").select("expr_id", F.col("value").alias("alt"), of["part"].alias("at"), F.lit(1).cast("long").alias("steps"), "ps", of["pos"].alias("_pos"))
        new = new.select("expr_id", "at", "steps", "alt", text_of(F.filter("ps", lambda x: x["pos"] < F.col("_pos"))).alias("pre"), text_of(F.filter("ps", lambda x: x["pos"] > F.col("_pos"))).alias("post"))
        ended, grown = got.filter("state <> 'settled'").isEmpty(), not new.isEmpty()
        if carried is not None:
            put = lambda v: F.coalesce(F.concat("pre", v, "post"), F.col("alt"))
            at = materialize(carried.join(hit.withColumnRenamed("part", "at"), "at", "left").withColumn("value", F.when(F.col("_hit"), put("_v"))), "url")
            rest = at.filter("_hit is null").select("expr_id", "at", "steps", "alt", "pre", "post")
            settled.append(at.filter("_hit").select("expr_id", "value"))
            after = [F.col(c).alias(f"_{c}") for c in ("at", "steps", "alt", "pre", "post")]
            to = rest.filter(F.col("steps") <= n).select(F.col("expr_id").alias("at"), *after, F.lit(None).cast("string").alias("_v"), F.lit(False).alias("_hit"))
            to = to.unionByName(at.filter("_hit").select(F.col("expr_id").alias("at"), *[F.lit(None).cast(rest.schema[c].dataType).alias(f"_{c}") for c in ("at", "steps", "alt", "pre", "post")], F.col("value").alias("_v"), "_hit"))
            two, step = F.col("_hit").isNotNull() & ~F.col("_hit") & (F.col("steps") <= n), lambda a, b: F.when(F.col("two"), a).otherwise(F.col(b)).alias(b)
            at = rest.join(to, "at", "left").withColumn("two", F.coalesce(two, F.lit(False)))
            at = at.select(
                "expr_id", F.coalesce("_hit", F.lit(False)).alias("done"), F.when(F.col("_hit"), put("_v")).alias("value"), step(F.col("_at"), "at"), step(F.col("steps") + F.col("_steps"), "steps"),
                step(put("_alt"), "alt"), step(F.concat("pre", "_pre"), "pre"), step(F.concat("_post", "post"), "post"),
            )
            at = materialize(at, "url")
            settled.append(at.filter("done").select("expr_id", "value"))
            ended = ended and at.filter("not done").isEmpty()
            new = new.unionByName(at.filter("not done").select(*new.columns))
        carried, news = new if grown or carried is not None else None, settled[0]
        for more in settled[1:]:
            news = news.unionByName(more)
        found.append(news)
        if ended or not grown and news.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out, "url"), ended


def ancestors(facts: Facts, starts: DataFrame) -> DataFrame:
    """(start, class_fqn, args, depth) of each start (start, class_fqn, args) and what it extends, with type arguments put in."""
    params = facts["src_class"].select("class_fqn", "type_params").dropDuplicates(["class_fqn"])
    sup = facts["supertype"].select("class_fqn", F.col("super_fqn"), "type_args").join(params, "class_fqn", "left")
    level = materialize(starts.select("start", "class_fqn", F.coalesce("args", F.array().cast("array<string>")).alias("args"), F.lit(0).alias("depth")).distinct(), "types")
    levels, depth = [level], 0
    while True:  # what has been met isn't entered again, so circles end
        depth += 1
        at = lambda a: F.array_position(F.coalesce("type_params", F.array().cast("array<string>")), a)
        put = F.transform("type_args", lambda a: F.when(at(a) > 0, F.try_element_at("args", at(a).cast("int"))).otherwise(a))
        nxt = level.join(sup, "class_fqn").select("start", F.col("super_fqn").alias("class_fqn"), F.coalesce(put, F.array().cast("array<string>")).alias("args"), F.lit(depth).alias("depth"))
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        level = materialize(nxt.distinct().join(out.select("start", "class_fqn", "args"), ["start", "class_fqn", "args"], "left_anti"), "types")
        if level.isEmpty():
            return out
        levels.append(level)
        if len(levels) > COMPACT:
            levels = [materialize(out, "types"), level]


def variables(facts: Facts) -> DataFrame:
    """(owner, variables) of each class with type parameters in scope: its own and those of the classes around it."""
    classes = facts["src_class"].select("class_fqn", "type_params").dropDuplicates(["class_fqn"])
    own = classes.filter(F.size("type_params") > 0).select(F.col("class_fqn").alias("around"), "type_params")
    names = F.split("class_fqn", r"[.$]")
    around = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.substring("class_fqn", F.lit(1), F.length(F.array_join(F.slice(names, F.lit(1), n), "."))))
    scopes = classes.select(F.col("class_fqn").alias("owner"), F.explode(around).alias("around")).join(own, "around")
    return scopes.groupBy("owner").agg(F.array_distinct(F.flatten(F.collect_list("type_params"))).alias("variables"))


def concrete(facts: Facts, rows: DataFrame, columns: list[str], owner: str) -> DataFrame:
    """``rows`` with each of ``columns`` (a class, or an array of classes) null where it is none that can be an entity: Object, a wildcard,
    or a type variable that the class ``owner``, in whose code it stands, has in scope; a variable of other classes is a name like any other.
    """
    known = variables(facts).select(F.col("owner").alias("_owner"), F.col("variables").alias("_variables"))
    out = rows.join(known, F.col(owner) == F.col("_owner"), "left")
    variable = lambda c: F.coalesce(F.array_contains("_variables", c), F.lit(False))
    one = lambda c: F.when(~c.isin("java.lang.Object", "Object", "?", "") & ~variable(c), c)
    arrays = {f.name for f in rows.schema.fields if f.dataType.typeName() == "array"}
    return out.withColumns({c: F.transform(c, one) if c in arrays else one(F.col(c)) for c in columns}).drop("_owner", "_variables")


def qualifiers(facts: Facts) -> DataFrame:
    """(qualifier_symbol, qualifier): the bean name asked for where a field or parameter is injected."""
    found = None
    for kind in ("field", "param"):
        q = annotated(facts, kind, "Qualifier", attribute("value"), "q")
        r = annotated(facts, kind, "Resource", attribute("name", "value"), "r")
        one = q.join(r, "target_id", "full").select(F.col("target_id").alias("qualifier_symbol"), F.coalesce("q", "r").alias("qualifier"))
        found = one if found is None else found.unionByName(one)
    return found.filter("qualifier is not null").groupBy("qualifier_symbol").agg(F.min("qualifier").alias("qualifier"))


def bean_names(facts: Facts) -> DataFrame:
    """(class_fqn, bean, is_primary)."""
    classes = facts["src_class"].select("class_fqn", "short_name").dropDuplicates(["class_fqn"])
    out = classes
    for i, short in enumerate(("Service", "Component", "Repository")):
        out = out.join(annotated(facts, "class", short, attribute("value"), f"b{i}").withColumnRenamed("target_id", "class_fqn"), "class_fqn", "left")
    primary = annotated(facts, "class", "Primary", F.lit("y"), "p").withColumnRenamed("target_id", "class_fqn")
    out = out.join(primary, "class_fqn", "left")
    return out.select("class_fqn", F.coalesce("b0", "b1", "b2", text.decapitalize(F.col("short_name"))).alias("bean"), F.col("p").isNotNull().alias("is_primary"))


def first_methods(facts: Facts) -> DataFrame:
    """``method`` rows, the first of each key."""
    rest = [c for c in facts["method"].columns if c != "method_key"]
    first = facts["method"].groupBy("method_key").agg(F.min_by(F.struct(*rest), F.struct(F.col("ord").isNull(), "ord", "project")).alias("m"))
    return first.select("method_key", "m.*")


def methods(facts: Facts) -> DataFrame:
    """``method`` rows with their class: is_abstract (or of an interface), virtual, label."""
    c = facts["src_class"].select("class_fqn", "kind", "is_final").dropDuplicates(["class_fqn"])
    m = first_methods(facts).join(c, "class_fqn", "left")
    has = lambda x: F.coalesce(F.array_contains("modifiers", x), F.lit(False))
    virtual = ~F.coalesce(F.arrays_overlap("modifiers", F.array(*[F.lit(x) for x in ("private", "static", "final", "constructor")])), F.lit(False))
    return m.withColumns(
        {
            "declared_abstract": has("abstract"),
            "is_abstract": has("abstract") | F.coalesce(F.col("kind") == "interface", F.lit(False)),
            "is_virtual": virtual & ~F.coalesce("is_final", F.lit(False)),
            "label": F.concat_ws(".", "class_fqn", "name"),
        }
    )


def accessors(facts: Facts) -> DataFrame:
    """Keys of trivial getters and setters: one statement that only returns or sets the field, or no body."""
    field = F.regexp_extract("name", "^(?:get|is|set)(.+)$", 1)
    named = (
        (F.col("name").rlike("^get.") & (F.size("param_types") == 0) & (F.col("return_type") != "void"))
        | (F.col("name").rlike("^is.") & (F.size("param_types") == 0) & F.col("return_type").isin("boolean", "java.lang.Boolean"))
        | (F.col("name").rlike("^set.") & (F.size("param_types") == 1))
    )
    m = facts["method"].filter(named).withColumn("field", text.decapitalize(field))
    f = facts["variable"].filter("kind = 'field'").select(F.col("owner_fqn").alias("class_fqn"), F.col("name").alias("field")).distinct()
    one = F.regexp_replace(F.try_element_at("stmts", F.lit(1)), r"\s+", "")
    does = F.when(F.col("name").startswith("set"), F.contains(one, F.concat("field", F.lit("=")))).otherwise(
        (one == F.concat(F.lit("return"), "field", F.lit(";"))) | (one == F.concat(F.lit("returnthis."), "field", F.lit(";")))
    )
    trivial = F.col("stmts").isNull() | ((F.size("stmts") == 1) & does)
    return m.join(f, ["class_fqn", "field"], "left_semi").filter(trivial).select("method_key").distinct()


def dispatch(facts: Facts, included: DataFrame, overrides: bool) -> DataFrame:
    """(callee_key, qualifier, target_key, reason): where a resolved call may go, itself (reason null) or implementations.

    Of several implementations those that the injection names stay, else the only primary one, else all.
    ``included`` (method_key) holds the methods that the graph may show.
    """
    m = methods(facts)
    calls = facts["call_site"].filter("callee_key is not null").join(qualifiers(facts), "qualifier_symbol", "left")
    asked = calls.select("callee_key", "qualifier").distinct()
    asked = asked.join(m.select(F.col("method_key").alias("callee_key"), "is_abstract", "is_virtual"), "callee_key")
    pairs = facts["override"].select(F.col("impl_method_key").alias("sub"), F.col("super_method_key").alias("super")).distinct()
    below = closure(pairs).select(F.col("ancestor").alias("callee_key"), F.col("sub").alias("target_key"))
    targets = m.select(F.col("method_key").alias("target_key"), "class_fqn", "declared_abstract").join(bean_names(facts), "class_fqn", "left")
    impl = asked.filter("is_abstract").join(below, "callee_key").join(targets.filter("not declared_abstract"), "target_key")
    named = F.col("qualifier").isNotNull() & (F.col("bean") == F.col("qualifier"))
    impl = impl.withColumn("_q", F.coalesce("qualifier", F.lit("")))
    impl = joins.narrow(impl, ["callee_key", "_q"], named, F.col("is_primary")).select("callee_key", "qualifier", "target_key", F.lit(True).alias("_iface"))
    if overrides:
        extra = asked.filter("not is_abstract and is_virtual").join(below, "callee_key").select("callee_key", "qualifier", "target_key", F.lit(False).alias("_iface"))
        impl = impl.unionByName(extra)
    impl = impl.join(included.withColumnRenamed("method_key", "target_key"), "target_key", "left_semi")
    counts = impl.filter("_iface").groupBy(F.col("callee_key").alias("_callee"), F.col("qualifier").alias("_qualifier")).agg(F.count("*").alias("_n"))
    impl = impl.join(counts, (F.col("callee_key") == F.col("_callee")) & F.col("qualifier").eqNullSafe(F.col("_qualifier")), "left")
    reason = F.when(F.col("_iface") & (F.col("_n") == 1), REASONS["only"]).when(F.col("_iface"), REASONS["several"]).otherwise(REASONS["override"])
    out = impl.select("callee_key", "qualifier", "target_key", reason.alias("reason"))
    found = out.filter(~F.col("reason").eqNullSafe(REASONS["override"])).select("callee_key").distinct()
    own = asked.join(found, "callee_key", "left_anti").select("callee_key", "qualifier", F.col("callee_key").alias("target_key"), F.lit(None).cast("string").alias("reason"))
    return out.unionByName(own)
