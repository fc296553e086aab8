"""Small fixed domains of the graph, as Python values and as columns over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The confidence of each resolution, by the tier it is in ("none": in no tier; counted as unresolved, but traversal follows it).
RESOLUTIONS: dict[str, dict[float, str]] = {
    "confirmed": {
        1.00: "exact_ast_match",
        0.95: "aspnetcore_controller fastapi_route_decorator local_function_exact nextjs_file_route same_file_exact same_package_exact spring_rest_controller",
        0.94: "aspnetcore_route_attribute nestjs_controller_route spring_route_resolved",
        0.92: "aspnetcore_minimal_api express_route_handler framework_route_resolved gin_route_resolved hertz_route_resolved receiver_method_exact spring_repository spring_service",
        0.90: "default_import_exact flask_route_decorator import_resolved imported_class_exact imported_function_exact imported_symbol_exact namespace_local_exact package_function_exact package_import_exact relative_import_exact self_method_resolved spring_controller spring_di_constructor static_method_exact this_method_exact",
        0.88: "annotation_resolved aspnetcore_di_constructor aspnetcore_map_group base_method_exact gin_group_route_resolved hertz_group_route_resolved imported_alias_exact imported_function_alias imported_module_attribute jsx_component_resolved nestjs_injection_resolved require_exact spring_component struct_method_exact using_namespace_exact",
        0.85: "module_exports_exact namespace_import_exact package_local_exact relative_import_resolved spring_di_autowired using_alias_exact",
        0.82: "parameter_type_hint_resolved",
        0.80: "barrel_export_resolved class_method_exact class_method_resolved local_instance_resolved",
        0.78: "module_instance_resolved",
        0.75: "constructor_call_resolved gin_middleware_chain hertz_middleware_chain self_attribute_instance_resolved type_hint_resolved",
    },
    "possible": {
        0.70: "same_module_fallback",
        0.65: "django_view_heuristic test_name_heuristic",
        0.55: "attribute_guess test_file_heuristic",
        0.50: "suggested_test",
        0.45: "filename_heuristic spring_bean_candidate",
        0.40: "docstring_reference embedded_method_candidate interface_method_candidate overloaded_method_candidate spring_overloaded_route",
        0.38: "extension_method_candidate",
        0.35: "gin_inline_handler hertz_inline_handler inline_handler name_match_candidate object_method_unknown",
        0.30: "callback_candidate unknown_receiver_method",
        0.25: "generated_code",
    },
    "unresolved": {
        0.50: "external_package package_external",
        0.45: "external_module",
        0.40: "external_symbol",
        0.30: "cgo_external unknown_external unknown_type_method",
        0.25: "dynamic_property_access import_not_found unknown_receiver",
        0.20: "decorator_unknown dynamic_dispatch dynamic_import dynamic_proxy require_unknown unknown_symbol unresolved",
        0.15: "any_unknown computed_property dynamic_getattr reflection_call",
    },
    "none": {
        0.95: "pydantic_model_detected symbol_name_match",
        0.90: "config_class_detected dataclass_model_detected direct_test_call",
        0.85: "call_graph_neighbor route_path_match sqlalchemy_model_detected",
        0.80: "field_name_match impact_neighbor model_field_match test_import_match",
        0.75: "config_constant_detected config_field_match file_path_match",
        0.70: "persistence_name_match repository_name_match store_name_match tag_match",
    },
}
UNKNOWN_CONFIDENCE = 0.20
HIGH, MEDIUM, LOW = 0.80, 0.60, 0.40
TRAVERSED = ("calls", "routes_to", "depends_on")
CALLABLES = ("function", "method", "class", "test")
PRODUCTION_TYPES = ("function", "method", "class", "module", "route", "controller", "service", "component")

#: Words in a lower-case path that make a change risky, and those of writing operations.
SENSITIVE_WORDS = "auth password token payment permission delete admin credential secret login security cert encrypt session rbac".split()
MUTATION_WORDS = "save write store persist create insert update set remove delete modify put patch commit flush sync upload".split()

#: Layer of a path, first match wins.
LAYERS = (
    ("graph", "graph/|graph_"), ("indexer", "indexer/"), ("context", "context/|evidence"), ("api", "api/|routes|router"), ("service", "service"),
    ("storage", "store/|storage/"), ("tests", "test"), ("config", "config|settings"), ("models", "model|schema"), ("persistence", "persistence|repository"), ("indexer", "cli/|cli_"),
)

#: Lower-case paths of tests, for ranking; of folders and file names, for coverage; of production code.
TEST_PATH = r"(^|/)tests/|(^|/)test/|(^|/)__tests__/|(^|/)spec/|(^|/)fixtures?/|(^|/)mocks?/|(^|/)__mocks__/|_test\.\w+$|^test_|test_[\w]*\.\w+$|^conftest\.|^setup\.|^teardown\.|^fixtures?\.|__test__"
TEST_FOLDER = r"(^|/)(tests?|__tests__|spec|specs|testing)/"
TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|conftest\.py|[^/]*\.(test|spec)\.[jt]sx?|[^/]*Tests?\.(java|cs)|[^/]*_test\.go)$"
PRODUCTION_ROOTS = "src app lib main pkg cmd controllers services models routes handlers middleware utils core api domain infrastructure application".split()
TEST_INTENT = "test tests testing spec coverage assert assertion mock mocking mockery fixture fixtures conftest pytest unittest jest vitest mocha".split()
EXCLUDED_FOLDERS = ".git venv .venv node_modules dist build __pycache__ .pytest_cache .mypy_cache".split()

#: Names and tags of entry points of frameworks.
ENTRY_TYPES = ("route", "controller", "service", "component")
ENTRY_TAGS = ("route", "controller", "service", "handler", "command", "cli")
ENTRY_NAME = "main|app|server|handler|router|middleware|command|run|start|init|bootstrap|setup"

#: Language of a file extension and how well it is supported.
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go", "cs": "csharp",
}
SUPPORT = {"python": "production", "typescript": "beta", "javascript": "beta", "java": "beta", "go": "beta", "csharp": "beta"}


def resolution_rows() -> list[tuple[str, str, float, bool]]:
    """resolution, tier, confidence, blocks_traversal."""
    return [(n, "unresolved" if t == "none" else t, c, t == "unresolved") for t, by in RESOLUTIONS.items() for c, names in by.items() for n in names.split()]


def resolutions(spark: SparkSession) -> DataFrame:
    """The dimension of resolutions; its size is fixed."""
    return spark.createDataFrame(resolution_rows(), "resolution string, tier string, default_confidence double, blocks_traversal boolean")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def tier(resolution: Column) -> Column:
    return F.coalesce(F.element_at(_map({n: t for n, t, _, _ in resolution_rows() if t != "unresolved"}), resolution), F.lit("unresolved"))


def blocks_traversal(resolution: Column) -> Column:
    return F.coalesce(resolution.isin([n for n, _, _, b in resolution_rows() if b]), F.lit(False))


def default_confidence(resolution: Column) -> Column:
    return F.coalesce(F.element_at(_map({n: c for n, _, c, _ in resolution_rows()}), resolution), F.lit(UNKNOWN_CONFIDENCE))


def confidence_level(c: Column) -> Column:
    return F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").when(c >= LOW, "low").otherwise("unknown")


def layer(path: Column) -> Column:
    p = F.lower(path)
    out = F.when(path.isNull(), F.lit("unknown"))
    for name, pattern in LAYERS:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("unknown")


def language(path: Column) -> Column:
    return F.element_at(_map(EXTENSIONS), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_test_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(TEST_PATH), F.lit(False))


def is_coverage_test_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(TEST_FOLDER) | path.rlike(TEST_FILE), F.lit(False))


def is_production_path(path: Column) -> Column:
    """A folder of production code below another one; each needs a slash before it."""
    return F.coalesce(F.lower(path).rlike("/(" + "|".join(PRODUCTION_ROOTS) + ")/"), F.lit(False))


def has_word(path: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(path).rlike("|".join(words)), F.lit(False))


def is_excluded(path: Column) -> Column:
    return F.coalesce(path.rlike("(^|/)(" + "|".join(w.replace(".", r"\.") for w in EXCLUDED_FOLDERS) + ")/"), F.lit(False))


def is_entry(node_type: Column, tags: Column, name: Column) -> Column:
    return node_type.isin(*ENTRY_TYPES) | F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, ENTRY_TAGS))), F.lit(False)) | F.coalesce(F.lower(name).rlike(ENTRY_NAME), F.lit(False))


def visibility(name: Column) -> Column:
    return F.when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def has_test_intent(query: str) -> bool:
    return any(w in query.lower() for w in TEST_INTENT)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob in which `*` crosses slashes."""
    import fnmatch

    return fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$")
