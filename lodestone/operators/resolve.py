"""Name resolution over fact tables: re-exports, longest prefixes, base classes, typed receivers, calls, database access, anchors.

Every rule is a join whose candidates carry a priority, and the best one stays by an aggregate, so no site's candidates are
ranked in a window of one task. Fact tables (any of them may come from real sources, sources/python_code.py, or from views):

    imports   module, ord, via (import_from, import, wildcard), name (null unless import_from), binding (null for a wildcard), target
    symbols   module, name, id, primitive (class, function, variable): the top level of each module
    packages  id: modules that stand for their folder
    bindings  module, name, target: what a name of the module means, one row a name

Ids that begin with `external::` are outside the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.storage import collect_shuffles, cut, release

#: Rounds of the re-export closure; classes that need no import.
CAP = 10
BUILTINS = ("object", "int", "float", "complex", "str", "bytes", "bytearray", "bool", "list", "tuple", "dict", "set", "frozenset", "type", "Exception", "BaseException", "ValueError", "TypeError", "KeyError", "IndexError", "RuntimeError", "NotImplementedError", "AttributeError", "LookupError", "OSError", "StopIteration")
#: Fixed value: an unresolved target of a database call.
NO_TABLE = "external::unresolved::db_target"


def is_external(target: str) -> Column:
    return F.col(target).startswith("external::")


def is_class(target: str, primitive: str) -> Column:
    """A class of the corpus, or an outside name of the shape package and symbol."""
    return F.coalesce((F.col(primitive) == "class") | (is_external(target) & (F.size(F.split(target, "::")) >= 4)), F.lit(False))


def confidence(target: Column) -> Column:
    """What an outside target's shape says of how it was found."""
    unknown = target.startswith("external::npm::unknown::") | target.startswith("external::pypi::unknown::")
    inside = target.startswith("external::unresolved::") & F.substring(target, 23, 1_000_000).contains("::")
    return F.when(unknown | inside, "unresolved_internal").when(target.startswith("external::unresolved::"), "unresolved_receiver").when(target.startswith("external::dynamic::"), "dynamic").otherwise("external")


# ---- imports


def _exports(edges: DataFrame, symbols: DataFrame, before: DataFrame | None) -> DataFrame:
    """module, name, target: what each package offers. The last explicit name wins; wildcards fill gaps, the first one first."""
    own = edges.where("package AND binding IS NOT NULL AND via IN ('import', 'import_from')")
    named = own.select("module", F.col("binding").alias("name"), "target", F.struct(F.lit(0).alias("rank"), (-F.col("ord")).alias("at"), F.lit(0).alias("source")).alias("place"))
    stars = edges.where("package AND via = 'wildcard'").select(F.col("module").alias("by"), F.col("target").alias("module"), "ord")
    star = lambda offered, source: stars.join(offered.where("NOT startswith(name, '_')"), "module").select(F.col("by").alias("module"), "name", "target", F.struct(F.lit(1).alias("rank"), F.col("ord").alias("at"), F.lit(source).alias("source")).alias("place"))
    offers = named.unionByName(star(symbols.select("module", "name", F.col("id").alias("target")), 0))
    if before is not None:
        offers = offers.unionByName(star(before, 1))
    return offers.groupBy("module", "name").agg(F.min_by("target", "place").alias("target"))


def reexports(imports: DataFrame, symbols: DataFrame, packages: DataFrame, cap: int = CAP) -> DataFrame:
    """imports, those that take a name from a package led on to what the package offers under it, through any chain of packages.

    A round works out what packages offer from their edges as they stand and from the offers of the round before, then moves every
    edge that still ends at a package. It ends when neither edges nor offers change, at the latest after cap rounds; the rest
    stays at its package. Only a package's own edges bear on what is offered, and where an edge of another module goes depends on
    its target and name alone: so rounds carry the edges of packages and the different (target, name) of the others, whose edges follow in one
    join at the end. Adds moved (whether the target changed). Each round writes its two tables once;
    an observation of the write tells what changed, so no round needs another job.
    """
    plain = packages.select(F.col("id").alias("module")).distinct()
    columns = imports.columns
    nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in imports.schema}
    own = imports.join(plain, "module", "left_semi").select(*columns, F.lit(True).alias("package"), F.col("target").alias("origin"), F.lit(False).alias("now"))
    # What ends elsewhere than at a package never moves.
    asked = imports.where("via = 'import_from' AND name IS NOT NULL").join(plain.withColumnRenamed("module", "target"), "target", "left_semi").select("target", "name").distinct()
    asked = asked.select(*[F.col(c) if c in ("target", "name") else F.lit("import_from").alias(c) if c == "via" else nothing[c] for c in columns], F.lit(False).alias("package"), F.col("target").alias("origin"), F.lit(False).alias("now"))
    edges = cut(own.unionByName(asked))
    symbols = cut(symbols.select("module", "name", "id").distinct())
    offers, state = None, None
    for _ in range(cap):
        seen = Observation()
        digest = [F.bit_xor(F.xxhash64(F.lit(k), "module", "name", "target")).alias(f"x{k}") for k in (0, 1)]
        next_offers = cut(_exports(edges, symbols, offers).observe(seen, F.count("*").alias("n"), *digest))
        if offers is not None:
            release(offers)
        offers = next_offers
        moves = offers.select(F.col("module").alias("target"), "name", F.col("target").alias("real"))
        led = edges.join(moves, ["target", "name"], "left")
        goes = F.coalesce((F.col("via") == "import_from") & (F.col("real") != F.col("target")), F.lit(False))
        moved = Observation()
        led = led.select(*[F.when(goes, F.col("real")).otherwise(F.col("target")).alias("target") if c == "target" else F.col(c) for c in columns], "package", "origin", goes.alias("now"))
        next_edges = cut(led.observe(moved, F.count_if("now").alias("n")))
        release(edges)
        edges = next_edges
        now = seen.get
        if not moved.get["n"] and now == state:
            break
        state = now
    release(offers, symbols)
    ends = edges.where("NOT package AND target <> origin").select(F.lit("import_from").alias("via"), F.col("origin").alias("target"), "name", F.col("target").alias("end"))
    got = imports.join(ends, ["via", "target", "name"], "left")
    return got.select(*[F.coalesce("end", "target").alias("target") if c == "target" else F.col(c) for c in columns], F.coalesce(F.col("end") != F.col("target"), F.col("target") != F.col("target")).alias("moved"))


def bindings(imports: DataFrame) -> DataFrame:
    """module, name, target: the last import of a name binds it."""
    return imports.where("binding IS NOT NULL").groupBy("module", F.col("binding").alias("name")).agg(F.max_by("target", "ord").alias("target"))


# ---- prefixes


def prefixes(parts: Column, mark: str) -> Column:
    """All prefixes of a list of parts, as (text, how many parts)."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), mark).alias("prefix"), n.alias("parts")))


def longest_prefix(uses: DataFrame, names: DataFrame, key: list[str], on: str, mark: str = ".") -> DataFrame:
    """uses, with target and parts of the longest prefix of column `on` that names has; null where none is.

    key tells uses apart. names has name, target and any further columns that must be equal. The prefixes are
    exploded and joined by equality, so nothing is compared with everything, and the longest is an aggregate with a partial step.
    """
    scope = [c for c in names.columns if c not in ("name", "target")]
    each = uses.where(F.length(on) > 0).select(*key, *[c for c in scope if c not in key], F.explode(prefixes(F.split(on, F.lit(rf"\Q{mark}\E")), mark)).alias("p"))
    met = each.select("*", F.col("p.prefix").alias("name")).join(names, [*scope, "name"])
    best = met.groupBy(*key).agg(F.max(F.struct(F.col("p.parts").alias("parts"), "target")).alias("best"))
    return uses.join(best, key, "left").select(*uses.columns, F.col("best.target").alias("target"), F.col("best.parts").alias("parts"))


# ---- classes


def base_classes(bases: DataFrame, names: DataFrame, symbols: DataFrame, builtins: tuple[str, ...] = BUILTINS) -> DataFrame:
    """src, ord, target, confidence: what each base of a class is.

    bases: src (class), module, ord, chain (what stands before the last dot, or null), name. In order: the longest prefix of the
    chain that the module binds, outside (with the name added) or a class of that module; a class of the own module; what the name is
    bound to, if a class or an outside symbol; a builtin; else an outside name of no known package.
    """
    classes = symbols.where("primitive = 'class'").select("module", "name", F.col("id").alias("id")).distinct()
    by_chain = longest_prefix(bases, names, ["src", "ord"], "chain").withColumnRenamed("target", "via")
    there = classes.select(F.col("module").alias("via"), "name", F.col("id").alias("theirs"))
    here = classes.select("module", "name", F.col("id").alias("own"))
    bound = names.select("module", "name", F.col("target").alias("bound"))
    known = classes.select(F.col("id").alias("bound"), F.lit("class").alias("bound_kind")).distinct()
    all_ = by_chain.join(there, ["via", "name"], "left").join(here, ["module", "name"], "left").join(bound, ["module", "name"], "left").join(known, "bound", "left")
    target = (
        F.when(is_external("via"), F.concat_ws("::", "via", "name"))
        .when(F.col("theirs").isNotNull(), F.col("theirs"))
        .when(F.col("own").isNotNull(), F.col("own"))
        .when(is_class("bound", "bound_kind"), F.col("bound"))
        .when(F.col("name").isin(*builtins), F.concat(F.lit("external::builtins::"), F.col("name")))
        .otherwise(F.concat(F.lit("external::pypi::unknown::"), F.col("name")))
    )
    return all_.where("name IS NOT NULL").select("src", "ord", target.alias("target")).withColumn("confidence", F.when(is_external("target"), confidence(F.col("target"))).otherwise("exact"))


# ---- calls


def typed(events: DataFrame, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """events, with types: of a call's receiver, what classes it may be when the call happens.

    events: fn, module, ord, op, var, type (a name), name (called), and owner (the class of the function, with op `self`). A typing event
    (`annotate`, `make` by a constructor, or `self`) whose type is a class replaces what its variable was; a call sees the latest one before it.
    One sort of a function's events by variable does that: a function's text bounds the group.
    """
    from pyspark.sql import Window

    ranked = symbols.select("module", "name", F.col("id").alias("target"), F.lit(0).alias("rank")).unionByName(names.select("module", "name", "target", F.lit(1).alias("rank")))
    meant = ranked.groupBy("module", "name").agg(F.min_by("target", "rank").alias("target")).join(symbols.select(F.col("id").alias("target"), "primitive").distinct(), "target", "left")
    found = meant.where(is_class("target", "primitive")).select("module", F.col("name").alias("type"), F.col("target").alias("class"))
    given = events.where("op <> 'call'").join(found, ["module", "type"], "left")
    builtin = (F.col("op") == "annotate") & F.col("type").isin(*BUILTINS)
    of = F.when(F.col("op") == "self", F.col("owner")).when(builtin, F.concat(F.lit("external::builtins::"), F.col("type"))).otherwise(F.col("class"))
    # Branches of a union are events of one place: together they are the new types.
    place = given.withColumn("given", of).where("given IS NOT NULL").groupBy("fn", "var", "ord").agg(F.array_sort(F.collect_set("given")).alias("types"))
    calls = events.where("op = 'call'")
    both = calls.withColumn("types", F.lit(None).cast("array<string>")).withColumn("is_call", F.lit(True)).unionByName(place.withColumn("is_call", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("fn", "var").orderBy("ord", "is_call").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("types", F.last("types", ignorenulls=True).over(before)).where("is_call").drop("is_call")


def call_edges(events: DataFrame, names: DataFrame, symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """fn, ord, target, kind, via, confidence of every call that means something.

    methods: class, name, id. A call has var (its receiver, null for a bare name) and name. Bare: the module's own name, else
    the bound one; a class is instantiated, a function or an outside name called. With a typed receiver: each type's method, an outside type's
    name with the method's added, else unresolved. Untyped: a bound outside name with the method's added, a symbol of a bound module, else unresolved.

    Events, typed calls and the edges of each of the three kinds are written, each once, and the shuffle files of a step are deleted before the
    next: the result reads none of the inputs any more.
    """
    spark = events.sparkSession
    # What earlier steps shuffled goes first.
    collect_shuffles(spark)
    events = cut(events.select("fn", "module", "ord", "op", "var", "type", "name", "owner"))
    collect_shuffles(spark)
    kinds = symbols.select(F.col("id").alias("target"), "primitive").distinct()
    # A module's names are its own symbols, and what it imports from the corpus.
    local = symbols.select("module", "name", F.col("id").alias("own")).distinct()
    offered = symbols.select("module", "name", F.col("id").alias("target"), F.lit(0).alias("rank")).unionByName(names.where(~is_external("target")).select("module", "name", "target", F.lit(1).alias("rank")))
    offered = offered.groupBy("module", "name").agg(F.min_by("target", "rank").alias("target"))
    bound = names.select("module", "name", F.col("target").alias("bound"))
    # A bare name has no receiver, so no type.
    calls = cut(typed(events.where("var IS NOT NULL"), names, symbols).select("fn", "module", "ord", "var", "name", "types"))
    collect_shuffles(spark)

    def called(df: DataFrame, via: str) -> DataFrame:
        got = df.join(kinds, "target", "left").where(F.col("primitive").isin("class", "function") | is_external("target"))
        return got.select("fn", "ord", "target", F.when(F.col("primitive") == "class", "instantiates").otherwise("calls").alias("kind"), F.lit(via).alias("via"), F.lit("exact").alias("confidence"))

    bare = events.where("op = 'call' AND var IS NULL").select("fn", "module", "ord", "name").join(local, ["module", "name"], "left").join(bound, ["module", "name"], "left")
    bare = cut(called(bare.select("fn", "ord", F.coalesce("own", "bound").alias("target")).where("target IS NOT NULL"), "function_call"))
    release(events)
    collect_shuffles(spark)

    sure = lambda found: F.when(found | ~is_external("target"), "exact").otherwise(confidence(F.col("target")))
    method = calls.where("size(types) > 0").select("fn", "ord", "name", F.explode("types").alias("class")).join(methods.select("class", "name", "id"), ["class", "name"], "left")
    to = F.when(is_external("class"), F.concat_ws("::", "class", "name")).when(F.col("id").isNotNull(), F.col("id")).otherwise(F.concat(F.lit("external::unresolved::"), "class", F.lit("."), "name"))
    method = method.select("fn", "ord", to.alias("target"))
    method = cut(method.select("fn", "ord", "target", F.lit("calls").alias("kind"), F.lit("method_call").alias("via"), sure(F.lit(False)).alias("confidence")))
    collect_shuffles(spark)

    loose = calls.where("types IS NULL").drop("types").join(bound.withColumnRenamed("name", "var"), ["module", "var"], "left")
    inside = offered.select(F.col("module").alias("bound"), "name", F.col("target").alias("symbol"))
    loose = loose.join(inside, ["bound", "name"], "left").join(kinds.select(F.col("target").alias("symbol"), F.col("primitive").alias("symbol_kind")), "symbol", "left")
    usable = F.col("symbol_kind").isin("class", "function")
    to = F.when(is_external("bound"), F.concat_ws("::", "bound", "name")).when(usable, F.col("symbol")).otherwise(F.concat(F.lit("external::unresolved::"), "var", F.lit("."), "name"))
    loose = loose.select("fn", "ord", to.alias("target"), F.when(~is_external("bound") & usable & (F.col("symbol_kind") == "class"), "instantiates").otherwise("calls").alias("kind"), (is_external("bound") | usable).alias("found"))
    loose = cut(loose.select("fn", "ord", "target", "kind", F.lit("method_call").alias("via"), sure(F.coalesce("found", F.lit(False))).alias("confidence")))
    release(calls)
    collect_shuffles(spark)
    return bare.unionByName(method).unionByName(loose)


# ---- tables


def sql_tables(text: Column) -> Column:
    """Names after FROM, JOIN, INTO and UPDATE in a SQL text, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def db_access(calls: DataFrame, names: DataFrame, schema_of: DataFrame, schemas: DataFrame, params: DataFrame) -> DataFrame:
    """fn, ord, target, confidence: the tables that database calls touch.

    calls: fn, module, ord, arg (a name, or null), sql (a text, or null). A name is a class of the module or, by params (fn, name, type),
    a variable of such a class; schema_of (class, schema) tells its table. A text's table names are looked up in schemas (name,
    id), an inverted index joined by equality. What is not found stays, as unresolved.
    """
    bound = names.select("module", F.col("name"), F.col("target").alias("class")).join(schema_of, "class").select("module", "name", "schema")
    direct = bound.withColumnsRenamed({"name": "arg", "schema": "direct"})
    by_type = params.select("fn", F.col("name").alias("arg"), "type")
    typed_ = bound.withColumnsRenamed({"name": "type", "schema": "by_type"})
    named = calls.where("sql IS NULL").join(direct, ["module", "arg"], "left").join(by_type, ["fn", "arg"], "left").join(typed_, ["module", "type"], "left")
    named = named.select("fn", "ord", F.coalesce("direct", "by_type", F.lit(NO_TABLE)).alias("target"))
    told = calls.where("sql IS NOT NULL").select("fn", "ord", F.explode_outer(sql_tables(F.col("sql"))).alias("name")).join(schemas.select("name", "id"), "name", "left")
    told = told.select("fn", "ord", F.coalesce("id", F.concat(F.lit("external::unresolved::table::"), F.col("name")), F.lit(NO_TABLE)).alias("target"))
    return named.unionByName(told).withColumn("confidence", F.when(is_external("target"), "unresolved_receiver").otherwise("exact"))


# ---- anchors


def anchors(domains: DataFrame, models: DataFrame) -> DataFrame:
    """id, model, how: the model that stands for each domain entry.

    domains: id, subkind, defined_in, table_name, mediated_by; models: id, file, tablename, name. In order: a model of the file with the
    table's name, any other model with it (resources); a model of the file with the class's name (roles); the first model of the file. A
    relationship is what its mediator is, through any chain of relationships; a chain that returns to itself has no
    model. Chains are halved in every round (each entry looks at its mediator's mediator), so long ones take few rounds.
    """
    own = domains.where("subkind <> 'relationship'").select("id", "subkind", "defined_in", "table_name")
    file = models.where("file IS NOT NULL").select(F.col("file").alias("defined_in"), F.col("id").alias("model"), "tablename", "name")
    place = lambda rank: F.struct(F.lit(rank).alias("rank"), "model")
    here = own.join(file, "defined_in")
    rank = F.when((F.col("subkind") == "resource") & (F.col("tablename") == F.col("table_name")), 0).when((F.col("subkind") == "role") & (F.col("name") == F.col("table_name")), 2).otherwise(3)
    near = here.select("id", F.struct(rank.alias("rank"), "model").alias("place"))
    by_table = models.where("tablename IS NOT NULL").groupBy(F.col("tablename").alias("table_name")).agg(F.min("id").alias("model"))
    far = own.where("subkind = 'resource'").join(by_table, "table_name").select("id", place(1).alias("place"))
    best = near.unionByName(far).groupBy("id").agg(F.min("place").alias("place"))
    how = F.when(F.col("place.rank") <= 1, "table_match").when(F.col("place.rank") == 2, "class_name_match").otherwise("defined_in")
    found = best.select("id", F.col("place.model").alias("model"), how.alias("how"))
    plain = own.select("id").join(found, "id", "left").select("id", "model", F.coalesce("how", F.lit("not_found")).alias("how"))
    # to: where a relationship's chain stands; it rests once it has left the relationships.
    related = domains.where("subkind = 'relationship'")
    chain = cut(related.select("id", F.col("mediated_by").alias("to"), F.lit(True).alias("on")))
    left = related.count()
    while left > 1:
        step = chain.alias("c").join(chain.alias("n"), F.col("c.to") == F.col("n.id"), "left")
        moved = Observation()
        inside = F.col("n.id").isNotNull()
        next_ = cut(step.select("c.id", F.when(inside, F.col("n.to")).otherwise(F.col("c.to")).alias("to"), inside.alias("on")).observe(moved, F.count_if("on").alias("n")))
        release(chain)
        chain = next_
        if not moved.get["n"]:
            break
        left = (left + 1) // 2  # a chain that has not left by then goes round
    ends = chain.join(found.select(F.col("id").alias("to"), "model"), "to", "left").select("id", "model", F.when(F.col("model").isNotNull(), "via_mediated_by").otherwise("not_found").alias("how"))
    return plain.unionByName(ends)
