"""References to the symbols they mean: one ladder of rungs per language, each rung an equi-join.

Every reference is looked up in all ways at once; a ladder then takes the first rung that found
something. A rung is a target column with its resolution and confidence, so the ladders are data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = ("function", "method", "class", "test")
BRACED_SUFFIX = r"(/index|/__init__)?\.\w+$"
_C = F.col


def _dotted(path: Column) -> Column:
    """The dotted module of a file; an initialiser or index file stands for its folder."""
    return F.regexp_replace(F.regexp_replace(path, BRACED_SUFFIX, ""), "/", ".")


def _suffixes(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def module_files(files: DataFrame) -> DataFrame:
    """What modules may be called: repo_id, module, target. A full path counts before a suffix, which has to be the only one.

    `files` has file_path and repo_id. Of files that differ only in extension the order is that of
    TypeScript: .ts, .tsx, .js, .jsx, then others.
    """
    order = F.when(_C("file_path").rlike(r"\.ts$"), 0).when(_C("file_path").rlike(r"\.tsx$"), 1).when(_C("file_path").rlike(r"\.js$"), 2).when(_C("file_path").rlike(r"\.jsx$"), 3).otherwise(4)
    f = files.select("repo_id", "file_path", _dotted(_C("file_path")).alias("full"), order.alias("o"), F.contains("file_path", F.lit("/index.")).cast("int").alias("index"))
    named = f.withColumn("module", F.explode(_suffixes(_C("full"))))
    best = named.groupBy("repo_id", "module").agg(
        F.min(F.when(_C("full") == _C("module"), F.struct("index", "o", "file_path"))).alias("exact"), F.min(F.struct("index", "o", "file_path")).alias("first"), F.count_distinct("full").alias("n")
    )
    target = F.coalesce("exact.file_path", F.when(_C("n") == 1, _C("first.file_path")))
    return best.select("repo_id", "module", target.alias("target")).where("target is not null")


def package_folders(files: DataFrame, modules: DataFrame) -> DataFrame:
    """For import paths of packages (Go) the folder with the longest common end: repo_id, module, folder.

    Both sides are small: distinct folders and distinct import paths, with their ends.
    """
    folder = F.regexp_replace(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1), "/", ".")
    ends = files.select("repo_id", folder.alias("folder")).distinct().select("repo_id", "folder", F.explode(_suffixes(_C("folder"))).alias("end"))
    asked = modules.select("repo_id", "module").distinct().select("repo_id", "module", F.explode(_suffixes(F.regexp_replace("module", "/", "."))).alias("end"))
    hit = asked.join(ends, ["repo_id", "end"]).groupBy("repo_id", "module").agg(F.max(F.struct(F.length("end").alias("n"), "folder")).alias("h"))
    return hit.select("repo_id", "module", _C("h.folder").alias("folder"))


def modules_of(links: DataFrame, files: DataFrame) -> DataFrame:
    """What each import path means, over distinct paths only: repo_id, module, module_file, parent_file, module_folder."""
    asked = links.where("module is not null").select("repo_id", "module", (_C("lang") == "go").alias("go")).distinct()
    dotted = F.regexp_replace("module", "/", ".")
    parent = F.when(F.contains(dotted, F.lit(".")), F.regexp_replace(dotted, r"\.[^.]*$", ""))
    ways = F.array(F.struct(F.lit(True).alias("own"), dotted.alias("m")), F.struct(F.lit(False).alias("own"), parent.alias("m")))
    hit = asked.select("repo_id", "module", F.inline(ways)).join(module_files(files).withColumnRenamed("module", "m"), ["repo_id", "m"])
    found = hit.groupBy("repo_id", "module").agg(F.max(F.when(_C("own"), _C("target"))).alias("module_file"), F.max(F.when(~_C("own"), _C("target"))).alias("parent_file"))
    folders = package_folders(files, asked.where("go")).withColumnRenamed("folder", "module_folder")
    return found.join(folders, ["repo_id", "module"], "full")


def _key(*parts: Column) -> Column:
    """16 bytes for one way of looking something up; null if a part is."""
    return F.when(F.concat(*parts).isNotNull(), F.unhex(F.md5(F.concat_ws("\0", *parts))))


def _symbol_keys(s: DataFrame) -> DataFrame:
    """Every symbol under every key that references look for it by: key, least and greatest id."""
    member = F.contains("inside", F.lit("."))
    lit = F.lit
    keys = [
        _key(lit("file"), _C("file_path"), _C("inside")), F.when(member, _key(lit("method"), _C("file_path"), _C("name"))), F.when(~member, _key(lit("package"), _C("repo_id"), _C("package"), _C("name"))),
        F.when(member, _key(lit("package"), _C("repo_id"), _C("package"), _C("inside"))), F.when(member, _key(lit("member"), _C("repo_id"), _C("inside"))), F.when(~member, _key(lit("top"), _C("repo_id"), _C("name"))), _key(lit("name"), _C("repo_id"), _C("name")),
    ]
    return s.select("id", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))


def lookups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each call and base class with everything it may mean, `m`: a map from ways of looking to the least and greatest symbol found.

    `links` has id (the source), file_path, repo_id, language_id, kind (call, inherits), name,
    qualifier (what stands before the name), module (where an imported name or qualifier comes from),
    package (of its file), receiver (the type of the qualifier, where the source tells) and via
    (how it tells). `nodes` has id, type, name, file_path, repo_id, package. Null repositories
    are one repository.

    All ways of looking go through one join: a reference becomes a row per way with a key of 16
    bytes, and the rows that found something come back to it.
    """
    repo = F.coalesce("repo_id", F.lit(""))
    s = nodes.where(_C("type").isin(*SYMBOLS)).select("id", "name", "type", "file_path", repo.alias("repo_id"), F.regexp_extract("id", r"::(.*)$", 1).alias("inside"), "package")
    files = nodes.where("type = 'file'").select("file_path", repo.alias("repo_id"))
    links = links.withColumn("link", F.monotonically_increasing_id()).withColumn("repo_id", repo).withColumnRenamed("language_id", "lang")
    c = links.where(_C("kind").isin("call", "inherits")).select(
        "link", _C("id").alias("source"), "file_path", "repo_id", "lang", "kind", "name", "qualifier", "module", "package", "receiver", "via", F.regexp_extract("id", r"::([^.]+)\.[^.]+$", 1).alias("own_class")
    )
    used = links.where("kind = 'import' and lang = 'csharp'").groupBy("file_path").agg(F.collect_set("module").alias("used"))  # the usings of one file
    # references without module meet nothing, and are spread so that they don't meet in one task
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\0"), "file_path"))
    c = c.withColumn("module_", spread(_C("module"))).join(modules_of(links, files).withColumnRenamed("module", "module_"), ["repo_id", "module_"], "left").drop("module_").join(used, "file_path", "left")
    dotted = F.regexp_replace("module", "/", ".")
    last, head = F.element_at(F.split(dotted, r"\."), -1), F.element_at(F.split("qualifier", r"\."), 1)
    of = lambda a: F.concat(_C(a) if isinstance(a, str) else a, F.lit("."), _C("name"))
    bare, inside, here = _C("qualifier").isNull(), _C("module_file"), F.coalesce("module_file", "parent_file")
    at = lambda file, name: _key(F.lit("file"), file, name)
    in_repo = lambda kind, *parts: _key(F.lit(kind), _C("repo_id"), *parts)
    wanted = F.when(bare, _C("name")).otherwise(of("qualifier"))
    ways = {
        "local": F.when(bare, at(_C("file_path"), _C("name"))), "local_init": F.when(bare, at(_C("file_path"), F.concat("name", F.lit(".__init__")))),
        "own": F.when(_C("own_class") != "", at(_C("file_path"), of("own_class"))), "local_member": at(_C("file_path"), of("qualifier")), "local_recv": F.when(_C("module").isNull(), at(_C("file_path"), of("receiver"))),
        "imp_name": at(inside, _C("name")), "imp_default": at(inside, last), "imp_member": F.when(~bare, at(F.coalesce("parent_file", "module_file"), of(last))), "imp_class": F.when(bare & (last == _C("name")), at(here, _C("name"))),
        "imp_own": F.when(~bare, at(inside, of(head))), "imp_recv": at(here, of("receiver")), "in_file": _key(F.lit("method"), _C("file_path"), _C("name")), "pkg_name": F.when(bare, in_repo("package", _C("package"), _C("name"))),
        "pkg_member": in_repo("package", _C("package"), of("qualifier")), "pkg_recv": F.when(_C("via") == "receiver", in_repo("package", _C("package"), of("receiver"))), "folder_name": in_repo("package", _C("module_folder"), _C("name")),
        "any_member": in_repo("member", of("qualifier")), "qualifier_class": in_repo("top", head), "named": F.when(bare, in_repo("name", _C("name"))),
    }
    listed = F.array(*[F.struct(F.lit(w).alias("way"), k.alias("key")) for w, k in ways.items()])
    spaces = F.transform(F.coalesce("used", F.array().cast("array<string>")), lambda ns: F.struct(F.lit("using").alias("way"), in_repo("package", ns, wanted).alias("key")))
    asked = c.select("link", F.inline(F.filter(F.concat(listed, spaces), lambda x: x["key"].isNotNull())))
    answers = asked.join(_symbol_keys(s), "key").groupBy("link", "way").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    m = answers.groupBy("link").agg(F.map_from_entries(F.collect_list(F.struct("way", F.struct("lo", "hi")))).alias("m"))  # a row per way
    w = Window.partitionBy("repo_id", "name").orderBy("id")
    three = s.where(F.contains("inside", F.lit(".")) & _C("id").rlike(r"\.go::")).select("repo_id", "name", "id").withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("repo_id", "name").agg(F.array_sort(F.collect_list("id")).alias("receivers"))
    method = spread(F.when((_C("lang") == "go") & ~bare, _C("name")))
    return c.join(m, "link", "left").withColumn("method_", method).join(three.withColumnRenamed("name", "method_"), ["repo_id", "method_"], "left").drop("method_", "link")


def _text(prefix: str, *parts: str) -> Column:
    """A target that is no symbol: `external:` or `unresolved:` with what the source writes."""
    return F.concat(F.lit(prefix), F.concat_ws(".", *[F.regexp_replace(p, "/", ".") for p in parts]))


def _when(cond: Column, target: Column) -> Column:
    return F.when(cond, target)


def _way(name: str) -> Column:
    """The least symbol that a way of looking found."""
    return F.element_at("m", F.lit(name))["lo"]


def ladders() -> dict[str, list[tuple[Column, str, float]]]:
    """Per language the rungs in order: target (null: go on), resolution, confidence."""
    inside = _C("module_file").isNotNull() | _C("parent_file").isNotNull() | _C("module_folder").isNotNull()
    own, bare, base = _C("qualifier").isin("self", "cls", "this"), _C("qualifier").isNull(), _C("kind") == "inherits"
    imported = _C("module").isNotNull()
    by_name = F.element_at("m", F.lit("named"))
    only = F.when(by_name["lo"] == by_name["hi"], by_name["lo"])
    recv = F.coalesce(_way("local_recv"), _way("imp_recv"))
    via = [("param", "parameter_type_hint_resolved", 0.82), ("local", "local_instance_resolved", 0.80), ("module", "module_instance_resolved", 0.78), ("self_attr", "self_attribute_instance_resolved", 0.75), ("ctor", "constructor_call_resolved", 0.75)]
    pascal = _C("name").rlike("^[A-Z]")
    python = [
        (_when(base, _way("local")), "same_file_exact", 0.95), (_when(base, F.coalesce(_way("imp_name"), _way("imp_class"))), "imported_class_exact", 0.90),
        (_when(bare & _way("local_init").isNotNull(), _way("local_init")), "class_method_resolved", 0.80), (_when(bare, _way("local")), "same_file_exact", 0.95), (_when(bare | own, _way("own")), "self_method_resolved", 0.90),
        *[(_when(_C("via") == v, recv), r, x) for v, r, x in via],
        (_when(bare & pascal, F.coalesce(_way("imp_name"), _way("imp_class"))), "constructor_call_resolved", 0.75), (_when(bare, _way("imp_name")), "imported_function_exact", 0.90),
        (_when(~bare, F.coalesce(_way("imp_name"), _way("imp_member"), _way("imp_own"))), "imported_module_attribute", 0.88), (_when(~bare, _way("local_member")), "class_method_resolved", 0.80),
        (_when(imported, _text("external:", "module", "name")), "external_package", 0.50), (_when(bare, _way("named")), "name_match_candidate", 0.35), (_text("external:", "qualifier", "name"), "unknown_external", 0.30),
    ]
    script = [
        (_when(own, F.coalesce(_way("own"), _way("in_file"))), "this_method_exact", 0.90), (_when(own, _text("unresolved:", "qualifier", "name")), "object_method_unknown", 0.35),
        (_when(bare, _way("local")), "same_file_exact", 0.95), (_when(bare, F.coalesce(_way("imp_name"), _way("imp_default"))), "imported_symbol_exact", 0.90), (_when(~bare, F.coalesce(_way("imp_name"), _way("imp_own"))), "namespace_import_exact", 0.85),
        (_when(~bare, _way("local_member")), "static_method_exact", 0.90), (_when(imported & inside, _text("unresolved:", "module", "name")), "name_match_candidate", 0.35), (_when(imported, _text("external:", "module", "name")), "package_external", 0.50),
        (_when(bare, _way("named")), "name_match_candidate", 0.35), (_text("external:", "qualifier", "name"), "unknown_external", 0.30),
    ]
    static = ~bare & _C("qualifier").rlike("^[A-Z]")
    java = [
        (_when(base, _way("local")), "same_file_exact", 0.95), (_when(base, F.coalesce(_way("imp_class"), _way("imp_name"))), "imported_class_exact", 0.90), (_when(base, _way("pkg_name")), "package_local_exact", 0.85), (_when(base & imported, _text("external:", "module")), "external_package", 0.50),
        (_when(base, _way("named")), "name_match_candidate", 0.35), (_when(base, _text("external:", "name")), "external_package", 0.50),
        (_when(own, F.coalesce(_way("own"), _way("in_file"))), "this_method_exact", 0.90), (_when(own, _text("unresolved:", "qualifier", "name")), "unknown_type_method", 0.30), (_when(_C("qualifier") == "super", _text("unresolved:", "qualifier", "name")), "interface_method_candidate", 0.40),
        (_when(static, F.coalesce(_way("imp_member"), _way("local_member"), _way("pkg_member"))), "static_method_exact", 0.90), (_when(static & imported & ~inside, _text("external:", "module", "name")), "external_package", 0.50), (_when(static, _text("unresolved:", "qualifier", "name")), "name_match_candidate", 0.35),
        (_when(~bare, _text("unresolved:", "qualifier", "name")), "unknown_type_method", 0.30), (F.coalesce(_way("local"), _way("own"), _way("in_file")), "same_file_exact", 0.95), (F.coalesce(_way("imp_class"), _when(imported, _way("imp_name"))), "imported_class_exact", 0.90), (_way("pkg_name"), "same_package_exact", 0.95),
        (_way("named"), "name_match_candidate", 0.35), (_text("external:", "name"), "unknown_symbol", 0.20),
    ]
    go = [
        (_when(bare, _way("local")), "same_file_exact", 0.95), (_when(~bare & imported, _way("folder_name")), "package_function_exact", 0.90), (_when(~bare & imported & inside, _text("unresolved:", "module", "name")), "name_match_candidate", 0.35),
        (_when(~bare & imported, _text("external:", "module", "name")), "external_module", 0.45), (_when(_C("via") == "receiver", F.coalesce(_way("local_recv"), _way("pkg_recv"))), "receiver_method_exact", 0.92), (_when(~bare, _C("receivers")[0]), "unknown_receiver_method", 0.30),
        (_when(~bare, _text("unresolved:", "qualifier", "name")), "embedded_method_candidate", 0.40), (_way("pkg_name"), "package_local_exact", 0.85), (only, "name_match_candidate", 0.35), (_way("named"), "name_match_candidate", 0.30), (_text("external:", "name"), "unknown_external", 0.30),
    ]
    csharp = [
        (_when(base, _way("local")), "same_file_exact", 0.95), (_when(base, _way("pkg_name")), "namespace_local_exact", 0.90), (_when(base, _way("using")), "using_namespace_exact", 0.88), (_when(base, _way("named")), "interface_method_candidate", 0.40), (_when(base, _text("external:", "name")), "external_package", 0.50),
        (_when(own, F.coalesce(_way("own"), _way("in_file"))), "this_method_exact", 0.90), (_when(_C("qualifier") == "base", _way("own")), "base_method_exact", 0.88), (_when(own | (_C("qualifier") == "base"), _text("unresolved:", "qualifier", "name")), "object_method_unknown", 0.35),
        (_when(~bare, _way("using")), "using_namespace_exact", 0.88), (_when(~bare, _way("pkg_member")), "namespace_local_exact", 0.90), (_when(~bare, _way("any_member")), "static_method_exact", 0.90), (_when(~bare & _way("qualifier_class").isNotNull(), _text("unresolved:", "qualifier", "name")), "unknown_type_method", 0.30),
        (_when(~bare, _text("unresolved:", "qualifier", "name")), "extension_method_candidate", 0.38), (F.coalesce(_way("local"), _way("own"), _way("in_file")), "same_file_exact", 0.95), (_way("pkg_name"), "namespace_local_exact", 0.90), (_way("using"), "using_namespace_exact", 0.88), (only, "name_match_candidate", 0.35),
        (_way("named"), "overloaded_method_candidate", 0.40), (_text("external:", "name"), "unknown_symbol", 0.20),
    ]
    return {"python": python, "javascript": script, "typescript": script, "java": java, "go": go, "csharp": csharp}


def resolve(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls and base classes with their targets: source, target, type, confidence, resolution, rung.

    Of the methods that an unknown receiver in Go may mean the first three are targets, each a row.
    A language without ladder gives no rows.
    """
    c = lookups(links, nodes)
    rungs = [(lang, i, *r) for lang, rs in ladders().items() for i, r in enumerate(rs, 1)]
    # a rung is a row of a list, the first whose target is there counts; a chain of conditions would outgrow a compiled method
    all_ = lambda lang: F.array(*[F.struct(t.alias("target"), F.lit(r).alias("resolution"), F.lit(x).alias("confidence"), F.lit(i).alias("rung")) for la, i, t, r, x in rungs if la == lang])
    lists = F.when(_C("lang") == "python", all_("python"))
    for lang in ("typescript", "javascript", "java", "go", "csharp"):
        lists = lists.when(_C("lang") == lang, all_(lang))
    c = c.withColumn("p", F.get(F.filter(lists, lambda x: x["target"].isNotNull()), F.lit(0))).where("p is not null")
    targets = F.when(_C("p.resolution") == "unknown_receiver_method", _C("receivers")).otherwise(F.array("p.target"))
    kind = F.when(_C("kind") == "call", "calls").otherwise("inherits")
    return c.select("source", F.explode(targets).alias("target"), kind.alias("type"), "p.confidence", "p.resolution", "p.rung")


def resolve_imports(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files to the file, folder's package or external module that each import means."""
    repo = F.coalesce("repo_id", F.lit(""))
    files = nodes.where("type = 'file'").select("file_path", repo.alias("repo_id"))
    dotted = F.regexp_replace("module", "/", ".")
    i = links.where("kind = 'import' and module is not null").select(_C("id").alias("source"), repo.alias("repo_id"), "module", _C("language_id").alias("lang"), F.when(_C("language_id") == "python", F.concat(dotted, F.lit("."), _C("name"))).alias("m")).distinct()
    member = module_files(files).select("repo_id", _C("module").alias("m"), _C("target").alias("member"))
    j = i.join(modules_of(i, files), ["repo_id", "module"], "left").join(member, ["repo_id", "m"], "left")
    found = F.coalesce("member", "module_file", F.when(_C("lang") == "java", _C("parent_file")))
    target = F.coalesce(found, F.when(_C("module_folder").isNotNull(), F.concat(F.lit("package:"), F.regexp_replace("module_folder", r"\.", "/"))), F.concat(F.lit("external:"), dotted))
    sure = found.isNotNull() | _C("module_folder").isNotNull()
    name = F.when(_C("module_folder").isNotNull() & found.isNull(), "package_import_exact").when(sure, "import_resolved").otherwise("external_module")
    return j.where(~target.eqNullSafe(_C("source"))).select("source", target.alias("target"), F.lit("imports").alias("type"), F.when(sure, 0.9).otherwise(0.45).alias("confidence"), name.alias("resolution"))


def merge_resolved(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """Raw edges with what resolution confirmed: on (source, target, type) the greater confidence and the resolved metadata count.

    `resolved` has a tier; only confirmed edges are merged, the others are drops(). Raw edges stay.
    """
    key = ["source", "target", "type"]
    r = resolved.where("tier = 'confirmed'").groupBy(*key).agg(F.max(F.struct("confidence", "resolution")).alias("r"))
    j = raw.groupBy(*key).agg(F.max(F.struct("confidence", "resolution")).alias("w")).join(r, key, "full")
    return j.select(*key, F.greatest("w.confidence", "r.confidence").alias("confidence"), F.coalesce("r.resolution", "w.resolution").alias("resolution"))


def drops(resolved: DataFrame) -> DataFrame:
    """What resolution could not confirm, with the reason: a log, not edges."""
    reason = F.when(_C("tier") == "possible", "framework_unresolved").otherwise("external_unresolved")
    return resolved.where("tier <> 'confirmed'").select(reason.alias("reason"), "source", "target", "type", "resolution")
