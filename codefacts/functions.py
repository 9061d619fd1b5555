"""Scalar functions on names, signatures, callees, specifiers and paths (Columns in, Columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type-name prefix -> meaning.
PREFIXES = {
    "A": "Actor subclass",
    "U": "UObject subclass",
    "F": "Struct or plain C++ class",
    "E": "Enum type",
    "I": "Interface",
    "T": "Template type",
    "S": "Slate widget",
    "None": "No UE prefix",
}
#: Callees that are no calls of interest.
BUILTIN_CALLEES = """check ensure verify checkf ensureMsgf verifyf UE_LOG UE_CLOG CA_SUPPRESS static_cast dynamic_cast const_cast reinterpret_cast
sizeof alignof offsetof decltype TEXT TEXTVIEW LOCTEXT NSLOCTEXT INVTEXT GENERATED_BODY GENERATED_UCLASS_BODY UCLASS USTRUCT UENUM UPROPERTY UFUNCTION UINTERFACE UMETA""".split()
#: Specifier keys that expose a symbol to scripts.
EXPOSING_KEYS = """BlueprintCallable BlueprintPure BlueprintReadWrite BlueprintReadOnly BlueprintImplementableEvent BlueprintNativeEvent BlueprintAssignable
Blueprintable BlueprintType BlueprintGetter BlueprintSetter""".split()


def name_prefix(name: Column) -> Column:
    """A, U, F, E, I, T or S before another capital letter, else None (as text)."""
    return F.when(name.rlike("^[AUFEITS]\\p{Lu}"), F.substring(name, 1, 1)).otherwise(F.lit("None"))


def name_prefix_description(prefix: Column) -> Column:
    return F.coalesce(*[F.when(prefix == p, F.lit(text)) for p, text in PREFIXES.items()])


def is_prefixed_type(name: Column) -> Column:
    return name_prefix(name) != "None"


def strip_name_prefix(name: Column) -> Column:
    return F.when(is_prefixed_type(name), F.substring(name, 2, 1 << 30)).otherwise(name)


def build_signature(return_type: Column, name: Column, parameters: Column, is_const: Column) -> Column:
    """``ret name(type name = default, ...) const``; parameters: array of structs with type, name, default_value."""
    one = lambda p: F.concat_ws(" ", F.nullif(p["type"], F.lit("")), F.nullif(p["name"], F.lit("")), F.concat(F.lit("= "), p["default_value"]))
    return F.concat(F.coalesce(F.concat(return_type, F.lit(" ")), F.lit("")), name, F.lit("("), F.array_join(F.transform(parameters, one), ", "), F.lit(")"), F.when(is_const, F.lit(" const")).otherwise(F.lit("")))


def qualified_name(parent: Column, name: Column) -> Column:
    return F.concat_ws("::", F.nullif(parent, F.lit("")), name)


def symbol_kind(name: Column, parent: Column) -> Column:
    """constructor, destructor, method or function."""
    last = F.element_at(F.split(parent, "::"), -1)
    return F.when(name.startswith("~"), "destructor").when(parent.isNotNull() & (last == name), "constructor").when(parent.isNotNull(), "method").otherwise("function")


def truncate_text(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def is_builtin_callee(name: Column) -> Column:
    return name.isin(BUILTIN_CALLEES) | ((name == F.upper(name)) & (F.length(name) > 2))


def is_blueprint_exposed(keys: Column) -> Column:
    return F.arrays_overlap(keys, F.array(*[F.lit(k) for k in EXPOSING_KEYS]))


def format_specifier(key: Column, value: Column) -> Column:
    return F.concat(key, F.coalesce(F.concat(F.lit("="), value), F.lit("")))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(forward_slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """With the dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def relative_path(path: Column, root: Column) -> Column:
    p, r = forward_slashes(path), F.rtrim(forward_slashes(root), F.lit("/"))
    return F.when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.lit(1 << 30))).otherwise(p)


def sanitize_query(query: Column) -> Column:
    """The words of a search text without the index's operators, each a prefix (with a star), by one blank."""
    bare = F.trim(F.regexp_replace(query, r'[*"():^~{}\[\]]', ""))
    return F.when(bare == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(bare, r"\s+"), lambda w: F.concat(w, F.lit("*"))), " "))


def classify_delegate(macro: Column) -> Column:
    """The class of a delegate or event declaration, by the words in its macro's name."""
    has = lambda *words: F.array_min(F.array(*[macro.contains(w) for w in words]))
    return (
        F.when(has("DYNAMIC_MULTICAST"), "DECLARE_DYNAMIC_MULTICAST_DELEGATE")
        .when(has("DYNAMIC"), "DECLARE_DYNAMIC_DELEGATE")
        .when(has("MULTICAST"), "DECLARE_MULTICAST_DELEGATE")
        .when(has("DELEGATE"), "DECLARE_DELEGATE")
        .when(has("EVENT"), "DECLARE_EVENT")
    )
