"""Compliance policies: facts of each file, rules, and how rules combine.

The facts of a file are one row, made from its bytes in one pass. A policy compiles to one column over that
row, the list of its violations; no rule reads the files again or joins anything. A file that breaks nothing
has no row. Files without objects or cross-references pass, as nothing can be said of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import files, structure
from foliant.functions.objects import from_json
from foliant.functions.structure import DANGEROUS
from foliant.operators.decode import per_file_struct

VIOLATION = ["rule", "kind", "obj_num", "detail"]
LIST = "array<struct<rule:string,kind:string,obj_num:long,detail:string>>"
FACTS = (
    "assembled boolean, fonts array<string>, dangerous_actions array<string>, object_count long, has_javascript boolean, has_embedded_file boolean, has_file_attachment boolean, has_external_uri boolean, has_encrypt boolean, "
    "actions array<struct<obj_num:long,under:string,s:string,has_s:boolean,has_js:boolean,uri:string>>, named_scripts array<long>, embedded array<long>, attachments array<long>, font_uses array<struct<obj_num:long,font:string>>, descendants array<long>"
)


def _facts(objects: list[tuple], xrefs: int, trailer: object) -> dict:
    return {"assembled": bool(objects) and xrefs > 0, **structure.facts(structure.by_number(objects), trailer)}


def facts_files(df: DataFrame, **options) -> DataFrame:
    """One row a file: fonts, what actions it has, what it holds, and what rules look at."""

    def kernel(content: bytes) -> dict:
        d = files.decode(content, **options)
        return _facts(d.objects, len(d.xrefs), d.trailer)

    return per_file_struct(df, kernel, FACTS)


def facts_df(decoded: DataFrame, meta: DataFrame) -> DataFrame:
    """facts_files of objects decoded before: facts of each object alone, put together by file. Only what was found is
    brought together, not the objects."""

    def kernel(row: dict) -> dict:
        value, number = from_json(row["json"]), row["number"]
        return {"seq": row["seq"], "assembled": True, **structure.facts({number: (value, None)} if number else {}, None if number else value)}

    last = decoded.groupBy("file_id", "obj_num").agg(F.min("seq").alias("seq"), F.max_by("prim_json", "seq").alias("json"))
    one = last.select("file_id", F.struct(F.col("obj_num").alias("number"), "seq", "json").alias("content"))
    trailer = meta.where("trailer_json is not null").select("file_id", F.struct(F.lit(0).cast("long").alias("number"), F.lit(-1).alias("seq"), F.col("trailer_json").alias("json")).alias("content"))
    made = per_file_struct(one.union(trailer), kernel, "seq int, " + FACTS)
    lists = ("actions", "named_scripts", "embedded", "attachments", "font_uses", "descendants")
    flags = ("has_javascript", "has_embedded_file", "has_file_attachment", "has_external_uri", "has_encrypt")

    def together(c: str) -> Column:
        held = F.sort_array(F.collect_list(F.when(F.size(c) > 0, F.struct("seq", F.col(c).alias("x")))))
        return F.flatten(F.transform(held, lambda x: x["x"])).alias(c)

    different = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size(c) > 0, F.col(c)))))).alias(c)
    found = made.groupBy("file_id").agg(different("fonts"), different("dangerous_actions"), F.sum("object_count").alias("object_count"), *[F.max(c).alias(c) for c in flags], *[together(c) for c in lists])
    kinds = {f.name: f.dataType for f in made.schema}
    files_ = meta.select("file_id", ((F.col("objects") > 0) & (F.col("xrefs") > 0)).alias("assembled")).join(found, "file_id", "left")
    empty = {**dict.fromkeys((*lists, "fonts", "dangerous_actions"), F.array()), **dict.fromkeys(flags, F.lit(False)), "object_count": F.lit(0)}
    return files_.select("file_id", "assembled", *[F.coalesce(F.col(c), empty[c].cast(kinds[c])).alias(c) for c in kinds if c in empty])


@dataclass(frozen=True)
class Policy:
    """violations: a column over a row of facts. & demands both, | either one."""

    violations: Callable[[], Column]

    def __and__(self, other: Policy) -> Policy:
        return Policy(lambda: F.concat(self.violations(), other.violations()))

    def __or__(self, other: Policy) -> Policy:
        def either() -> Column:
            a, b = self.violations(), other.violations()
            return F.when((F.size(a) > 0) & (F.size(b) > 0), F.concat(a, b)).otherwise(F.array().cast(LIST))

        return Policy(either)


def _violation(rule: str, kind: str, obj_num: Column | None = None, detail: Column | None = None) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), (F.lit(None) if obj_num is None else obj_num).cast("long").alias("obj_num"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _each(rule: str, kind: str, of: Column, where: Callable[[Column], Column] | None = None, detail: Callable[[Column], Column] | None = None, number: Callable[[Column], Column] = lambda x: x["obj_num"]) -> Column:
    found = of if where is None else F.filter(of, where)
    return F.transform(found, lambda x: _violation(rule, kind, number(x), None if detail is None else detail(x))).cast(LIST)


PASS = permissive = Policy(lambda: F.array().cast(LIST))


def ban_javascript() -> Policy:
    def found() -> Column:
        acting = _each("banJavaScript", "JavaScript", F.col("actions"), lambda a: a["under"].isNotNull() & (a["has_js"] | F.coalesce(a["s"] == "JavaScript", F.lit(False))), lambda a: a["under"])
        bare = _each("banJavaScript", "JavaScript", F.col("actions"), lambda a: a["under"].isNull() & a["has_js"] & ~a["has_s"], lambda a: F.lit("JS"))
        named = _each("banJavaScript", "JavaScript", F.col("named_scripts"), None, lambda n: F.lit("Names.JavaScript"), lambda n: n)
        return F.concat(acting, bare, named)

    return Policy(found)


def ban_actions(*names: str) -> Policy:
    return Policy(lambda: _each("banActions", "DangerousAction", F.col("actions"), lambda a: a["under"].isNotNull() & a["s"].isin(*names), lambda a: a["s"]))


def ban_dangerous_actions() -> Policy:
    return ban_actions(*DANGEROUS)


def ban_external_uri() -> Policy:
    return Policy(lambda: _each("banExternalUri", "ExternalUri", F.col("actions"), lambda a: a["under"].isNotNull() & (a["s"] == "URI"), lambda a: F.coalesce(a["uri"], F.lit("<non-string>"))))


def ban_embedded_files() -> Policy:
    return Policy(lambda: _each("banEmbeddedFiles", "EmbeddedFile", F.col("embedded"), number=lambda n: n))


def ban_file_attachments() -> Policy:
    return Policy(lambda: _each("banFileAttachments", "FileAttachment", F.col("attachments"), number=lambda n: n))


def deny_fonts(*names: str) -> Policy:
    """Fonts by name in objects, not in the trailer; once more for fonts that a composite font refers to."""

    def found() -> Column:
        uses = F.filter("font_uses", lambda f: f["font"].isin(*names))
        again = F.flatten(F.transform("descendants", lambda n: F.filter(uses, lambda f: f["obj_num"] == n)))
        return _each("denyFonts", "DeniedFont", F.concat(uses, again), None, lambda f: f["font"])

    return Policy(found)


def reject(reason: str) -> Policy:
    return Policy(lambda: F.array(_violation("reject", "Custom", None, F.lit(reason))).cast(LIST))


def check(name: str, fails: Column) -> Policy:
    """A rule of one's own: files whose facts make `fails` true."""
    return Policy(lambda: F.when(fails, F.array(_violation(name, "Custom", None, F.lit(name)))).otherwise(F.array()).cast(LIST))


def if_else(condition: Column, then: Policy, other: Policy = PASS) -> Policy:
    return Policy(lambda: F.when(condition, then.violations()).otherwise(other.violations()))


def when(condition: Column, then: Policy) -> Policy:
    return if_else(condition, then)


def unless(condition: Column, then: Policy) -> Policy:
    return if_else(condition, PASS, then)


def all_of(*policies: Policy) -> Policy:
    out = policies[0] if policies else PASS
    for p in policies[1:]:
        out = out & p
    return out


def any_of(*policies: Policy) -> Policy:
    out = policies[0] if policies else PASS
    for p in policies[1:]:
        out = out | p
    return out


def uses_font(name: str) -> Column:
    return F.array_contains("fonts", name)


def uses_any_font(*names: str) -> Column:
    return F.arrays_overlap("fonts", F.array(*map(F.lit, names)))


def has_dangerous_action() -> Column:
    return F.size("dangerous_actions") > 0


def object_count_at_least(n: int) -> Column:
    return F.col("object_count") >= n


def object_count_less_than(n: int) -> Column:
    return F.col("object_count") < n


def strict() -> Policy:
    return ban_javascript() & ban_dangerous_actions()


def config(denied_fonts: tuple[str, ...] = (), javascript: bool = True, dangerous_actions: bool = True, embedded_files: bool = False, file_attachments: bool = False, external_uri: bool = False) -> Policy:
    """A policy from switches: what is true is banned."""
    chosen = [rule() for on, rule in ((javascript, ban_javascript), (dangerous_actions, ban_dangerous_actions), (embedded_files, ban_embedded_files), (file_attachments, ban_file_attachments), (external_uri, ban_external_uri)) if on]
    return all_of(*chosen, *([deny_fonts(*denied_fonts)] if denied_fonts else []))


def violations_of(facts: DataFrame, policy: Policy) -> DataFrame:
    """(file_id, rule, kind, obj_num, detail) of each violation."""
    return facts.where("assembled").select("file_id", F.inline(policy.violations()))


def violations_files(df: DataFrame, policy: Policy, **options) -> DataFrame:
    return violations_of(facts_files(df, **options), policy)


def violations_df(decoded: DataFrame, meta: DataFrame, policy: Policy) -> DataFrame:
    return violations_of(facts_df(decoded, meta), policy)
