"""Field descriptions: type, role, format, behavior and the aggregation rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tabwright.columns import kind

TYPES = ("number", "string", "date", "boolean")
ROLES = ("time", "metric", "dimension", "status", "identifier", "ignored")
FORMATS = (
    "plain", "integer", "decimal", "percentage",
    "currency", "duration", "date", "datetime",
)
# What a field's default may be; median and last are for explicit requests only.
DEFAULT_AGGREGATIONS = ("sum", "avg", "count", "max", "min")
BEHAVIORS = (
    "flow", "stock", "rate", "duration", "score", "currency", "count", "unknown",
)

# Name keywords that decide the role of a column.
TIME_WORDS = ["日期", "时间", "date", "time", "月份", "周", "日", "创建", "更新"]
STATUS_WORDS = [
    "状态", "预警", "风险", "等级", "健康", "flag", "status", "是否正常", "是否达标", "告警",
]
DIMENSION_WORDS = [
    "客户", "地区", "区域", "渠道", "群", "负责", "部门", "门店", "产品", "类目", "来源",
    "城市", "行业", "类型", "标签",
]
RATE_WORDS = ["率", "占比", "比例", "百分", "roi", "留存", "转化"]
ID_WORDS = ["id", "编号", "序号", "姓名", "手机号", "手机", "账号", "邮箱"]


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"
    role: str = "dimension"
    format: str = "plain"
    behavior: str = "unknown"
    aggregation: str | None = None
    include: bool = True

    def __post_init__(self) -> None:
        for value, allowed, what in (
            (self.type, TYPES, "type"),
            (self.role, ROLES, "role"),
            (self.format, FORMATS, "format"),
            (self.behavior, BEHAVIORS, "behavior"),
        ):
            if value not in allowed:
                raise ValueError(f"{self.name}: {value!r} is not a field {what}")


def mentions(name: str, words: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(w in lowered for w in words)


def infer_role(name: str, type_: str, format_: str, distinct: int, rows: int) -> str:
    """Role from the name's keywords, the type and how unique the values are."""
    if type_ == "date" or mentions(name, TIME_WORDS):
        return "time"
    if mentions(name, STATUS_WORDS):
        return "status"
    if type_ != "number":
        if not mentions(name, DIMENSION_WORDS) and mentions(name, ID_WORDS):
            return "identifier"
        return "dimension"
    if mentions(name, ID_WORDS):
        return "identifier"
    is_rate = format_ == "percentage" or mentions(name, RATE_WORDS)
    every_value_differs = rows > 10 and distinct == rows
    return "identifier" if every_value_differs and not is_rate else "metric"


def default_aggregation(type_: str, role: str, format_: str) -> str:
    """The aggregation suggested when a column is first inferred."""
    if type_ != "number" or role == "identifier":
        return "count"
    return "avg" if format_ == "percentage" else "sum"


def allows(spec: FieldSpec, aggregation: str) -> bool:
    """Whether a field may be summarised this way at all."""
    if aggregation == "count":
        return True
    if spec.type != "number":
        return False
    banned = set()
    if spec.format == "percentage" or spec.behavior == "rate":
        banned.add("sum")
    if spec.role == "identifier":
        banned.update(("sum", "avg"))
    return aggregation not in banned


def check_aggregation(spec: FieldSpec, aggregation: str) -> None:
    if not allows(spec, aggregation):
        raise ValueError(
            f"{spec.name} ({spec.type}, {spec.format}, {spec.role}) "
            f"cannot be aggregated by {aggregation}"
        )


def resolve_aggregation(spec: FieldSpec) -> str:
    """The user's choice when it is legal, else the rule for the field's format."""
    if spec.aggregation in DEFAULT_AGGREGATIONS and allows(spec, spec.aggregation):
        return spec.aggregation
    if spec.type != "number" or spec.role == "identifier":
        return "count"
    return "avg" if spec.format in ("percentage", "duration") else "sum"


def behavior_aggregation(spec: FieldSpec | None) -> str:
    """Default for a time series: a stock keeps its last value, a rate averages."""
    behavior = spec.behavior if spec else "unknown"
    return {"stock": "last", "rate": "avg", "score": "avg"}.get(behavior, "sum")


def specs_of(
    df: DataFrame, overrides: Mapping[str, Mapping[str, str]] | None = None
) -> list[FieldSpec]:
    """Specs for an already typed DataFrame; ``overrides`` adds role, format, ..."""
    overrides = overrides or {}
    unknown = set(overrides) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown field(s): {', '.join(sorted(unknown))}")
    roles = {"number": "metric", "date": "time"}
    specs = []
    for name in df.columns:
        k = kind(df, name)
        base = FieldSpec(
            name, k, roles.get(k, "dimension"), "date" if k == "date" else "plain"
        )
        specs.append(replace(base, **overrides.get(name, {})))
    return specs


@dataclass(frozen=True)
class RoleSplit:
    """Included fields by role; the first time and dimension field lead."""

    active: list[FieldSpec] = field(default_factory=list)
    time: FieldSpec | None = None
    dimension: FieldSpec | None = None
    dimensions: list[FieldSpec] = field(default_factory=list)
    statuses: list[FieldSpec] = field(default_factory=list)
    metrics: list[FieldSpec] = field(default_factory=list)
    identifiers: list[FieldSpec] = field(default_factory=list)
    ignored: list[FieldSpec] = field(default_factory=list)


def split_roles(specs: list[FieldSpec]) -> RoleSplit:
    active = [s for s in specs if s.include]

    def with_role(role: str, pool: list[FieldSpec]) -> list[FieldSpec]:
        return [s for s in pool if s.role == role]

    times, dims = with_role("time", active), with_role("dimension", active)
    return RoleSplit(
        active=active,
        time=times[0] if times else None,
        dimension=dims[0] if dims else None,
        dimensions=dims,
        statuses=with_role("status", active),
        metrics=with_role("metric", active),
        identifiers=with_role("identifier", active),
        ignored=with_role("ignored", specs),
    )
