"""Typed evidence: strict decoding of payloads, eligibility of test runs, failure signatures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import domain_hash, signature_key

MOST_PAYLOAD_BYTES = 64 * 1024


@dataclass(frozen=True)
class Contract:
    """name and version, the event types that may carry it, its fields, and those required."""

    name: str
    version: int
    event_types: tuple[str, ...]
    schema: T.StructType
    required: tuple[str, ...]


_subject = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONTRACTS = (
    Contract("external_tool_completion", 1, ("tool",), _struct(tool=_s, operation=_s, exit_code=_l, error_class=_s, message=_s), ("tool", "operation", "exit_code")),
    Contract("rust_compiler_result", 1, ("compiler",), _struct(subject=_subject, exit_code=_l, diagnostics=T.ArrayType(_struct(level=_s, code=_s, message=_s, expected_type=_s, actual_type=_s, path=_s, start_line=_l, start_column=_l))), ("subject", "exit_code")),
    Contract("cargo_test_result", 1, ("test",), _struct(subject=_subject, exit_code=_l, failures=T.ArrayType(_struct(test_name=_s, assertion_class=_s, message=_s))), ("subject", "exit_code")),
    Contract("test_run_result", 1, ("test",), _struct(run_id=_s, operation=_s, completed=_b, exit_code=_l, language=_s), ("run_id", "operation")),
    Contract("generic_verifier_result", 1, ("verifier",), _struct(tool=_s, operation=_s, subject=_subject, passed=_b), ("tool", "passed")),
    Contract("source_change", 1, ("change",), _struct(path=_s, kind=_s), ("path",)),
    Contract("user_acceptance", 1, ("acceptance",), _struct(subject=_subject, accepted=_b, note=_s), ("accepted",)),
)


def registry(contracts: tuple[Contract, ...] = CONTRACTS) -> dict[tuple[str, int], Contract]:
    out: dict[tuple[str, int], Contract] = {}
    for c in contracts:
        if (c.name, c.version) in out:
            raise ValueError(f"{c.name} {c.version} is registered twice")
        out[c.name, c.version] = c
    return out


def decoded(events: DataFrame, contracts: tuple[Contract, ...] = CONTRACTS) -> DataFrame:
    """``events`` (event_type, contract, version, payload) with a status and, for each
    contract, its decoded payload.

    Decoding is strict: an unknown field makes a payload invalid, as does a missing
    required one, text that is no JSON object, or too many bytes.
    """
    status = F.lit("unsupported_contract")
    out = events
    for (name, version), c in registry(contracts).items():
        is_it = (F.col("contract") == name) & (F.col("version") == version)
        parsed = F.from_json("payload", c.schema)
        keys = F.json_object_keys("payload")
        unknown = F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in c.schema]))) > 0
        missing = reduce(lambda a, b: a | b, [parsed[r].isNull() for r in c.required])
        own = (
            F.when(~F.col("event_type").isin(*c.event_types), "wrong_event_type").when(F.octet_length("payload") > MOST_PAYLOAD_BYTES, "payload_too_large")
            .when(keys.isNull(), "invalid_json").when(unknown, "unknown_field").when(missing, "missing_field").otherwise("decoded")
        )
        status = F.when(is_it, own).otherwise(status)
        out = out.withColumn(name, F.when(is_it, parsed))
    out = out.withColumn("status", status)
    for c in contracts:
        out = out.withColumn(c.name, F.when(F.col("status") == "decoded", F.col(c.name)))
    return out


#: Flags of a run that make it ineligible, and the issue that each raises.
FLAGS = {"focused_only": "focused_selection_unsupported", "name_filter": "name_filter_unsupported", "sharded": "sharded_execution_unsupported", "bail": "bail_execution_unsupported", "watch": "watch_execution_unsupported", "pass_with_no_tests": "pass_with_no_tests_unsupported"}
COUNTS = {"skipped": "skipped_tests", "todo": "todo_tests", "pending": "pending_tests", "expected_failed": "expected_failures", "unexpected_successful": "unexpected_successes", "errored": "test_execution_errors"}


def eligibility(runs: DataFrame) -> DataFrame:
    """``runs`` (flat columns) with status and issues, all that apply, in a fixed order.

    Absent columns are taken as harmless.
    """
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in runs.columns else F.lit(default)
    rules: list[tuple[Column, str]] = [
        (~has("profile_known", True), "unsupported_test_profile"),
        (~has("profile_matches", True), "test_profile_component_mismatch"),
        (~has("selection_kind", "file").isin("file", "module", "class"), "unsupported_test_selection"),
        (~has("language_supported", True), "unsupported_test_language"),
        (~has("completed", True) | (F.col("exit_code").isNull() if "exit_code" in runs.columns else F.lit(False)), "incomplete_test_run"),
        (~has("inventory_complete", True), "incomplete_test_inventory"),
        ((has("discovered", 1) == 0) | (has("executed", 1) == 0), "empty_test_run"),
        (has("errors", 0) > 0, "test_run_errors"),
        (has("children", 0) > 0, "child_observations_unsupported"),
        *[(has(c, 0) > 0, code) for c, code in COUNTS.items()],
        (has("retries", 0) > 0, "test_retries_unsupported"),
        (has("repeats", 0) > 0, "test_repeats_unsupported"),
        *[(has(c, False), code) for c, code in FLAGS.items()],
        (has("snapshot_mode", "none").isin("create_missing", "update_all"), "snapshot_update_unsupported"),
        (has("execution_origin", "current") != "current", "non_current_test_execution"),
        (has("artifacts", 1) == 0, "missing_capture_artifact"),
        (has("assertion_failed", 0) > 1, "multiple_test_failures"),
    ]
    passed = (has("exit_code", 0) == 0) & (has("assertion_failed", 0) == 0) & (has("passed", 0) == has("executed", 0))
    failed = (has("exit_code", 0) != 0) & (has("assertion_failed", 0) == 1)
    rules.append((~(passed | failed), "unsupported_test_outcome"))
    issues = F.filter(F.array(*[F.when(cond, code) for cond, code in rules]), lambda x: x.isNotNull())
    status = F.when(F.size("issues") > 0, "ineligible").when(passed, "eligible_passed").otherwise("eligible_failed")
    return runs.withColumn("issues", issues).withColumn("status", status)


def scope_fingerprint(cases: DataFrame, *keys: str) -> DataFrame:
    """Hash of a run's sorted case identities: equal runs cover the same inventory."""
    return cases.groupBy(*keys).agg(domain_hash("scope", F.array_join(F.array_sort(F.collect_set("identity")), "\n")).alias("fingerprint"))


def stable(value: Column) -> Column:
    """Whether a text can stand for the same thing in any report: short, of few characters."""
    return F.coalesce(F.rlike(value, F.lit(r"\A[A-Za-z0-9_.:<>, &-]{1,512}\z")), F.lit(False))


def relative(path: Column) -> Column:
    return F.rlike(path, F.lit(r"\A[A-Za-z0-9_./-]{1,512}\z")) & ~F.rlike(path, F.lit(r"(^|/)(\.\.)?(/|\z)"))


def compiler_failure(reports: DataFrame) -> DataFrame:
    """Signature of a compiler report with exactly one error: report_id, status, components,
    key. Only a type mismatch with both types is an exact identity."""
    errors = F.filter("diagnostics", lambda d: d["level"] == "error")
    one = F.get(errors, F.lit(0))
    code = one["code"]
    typed = one["expected_type"].isNotNull() & one["actual_type"].isNotNull()
    status = (
        F.when(F.col("exit_code") == 0, "not_a_failure").when(F.size(errors) != 1, "ambiguous_compiler_diagnostics").when(~F.rlike(F.coalesce(code, F.lit("")), F.lit("^E[0-9]{4}$")), "missing_structured_diagnostic_code")
        .when(~stable(F.col("subject.value")), "invalid_verification_subject")
        .when(one["path"].isNull(), "missing_failure_scope_path").when(~relative(one["path"]), "unsafe_diagnostic_path")
        .when((code == "E0308") & ~typed, "missing_type_distinction").when((code == "E0308") & ~(stable(one["expected_type"]) & stable(one["actual_type"])), "unsafe_type_distinction").when(code == "E0308", "exact").otherwise("compatible_only")
    )
    pairs = {"diagnostic_code": code, "subject_kind": F.col("subject.kind"), "subject_value": F.col("subject.value"), "expected_type": F.when(code == "E0308", one["expected_type"]), "actual_type": F.when(code == "E0308", one["actual_type"])}
    return _signed(reports, status, pairs, {"domain": F.lit("compiler"), "path": one["path"]})


def test_failure(reports: DataFrame) -> DataFrame:
    """Signature of a test report with exactly one failure; never an exact identity. Names and
    classes that aren't stable texts identify nothing and are left out."""
    one = F.get("failures", F.lit(0))
    name, kind = (F.when(stable(one[c]), one[c]) for c in ("test_name", "assertion_class"))
    status = (
        F.when(F.col("exit_code") == 0, "not_a_failure").when(F.size("failures") != 1, "ambiguous_test_failures").when(~stable(F.col("subject.value")), "invalid_verification_subject")
        .when(name.isNull() & kind.isNull(), "missing_test_identity").otherwise("compatible_only")
    )
    pairs = {"subject_kind": F.col("subject.kind"), "subject_value": F.col("subject.value"), "test_name": name, "assertion_class": kind}
    return _signed(reports, status, pairs, {"domain": F.lit("test"), "path": F.lit("")})


def test_run_failure(runs: DataFrame) -> DataFrame:
    """Signature of a run (see ``eligibility``, whose ``status`` it has) with one case that
    failed by assertion; never an exact identity.

    Cases: array of (status, namespace, name, error_class).
    """
    failed = F.filter("cases", lambda c: c["status"] == "assertion_failed")
    one = F.get(failed, F.lit(0))
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    namespace = F.concat(F.size(one["namespace"]).cast("string"), F.lit(":"), F.array_join(F.transform(one["namespace"], part), ""))
    eligible = F.coalesce(F.col("status") == "eligible_failed", F.lit(False))
    status = F.when(~eligible, "ineligible_test_run_failure").when(F.size(failed) != 1, "ambiguous_test_run_failure").otherwise("compatible_only")
    plain = ("profile_id", "profile_version", "runner_id", "runner_version", "project_root", "import_root", "selection_kind", "selection_value")
    pairs = {c: F.col(c) for c in plain} | {"case_namespace": namespace, "case_name": one["name"], "error_class": one["error_class"]}
    return _signed(runs.withColumnRenamed("run_id", "report_id"), status, pairs, {"domain": F.lit("test_run"), "path": F.col("test_file")})


def registered_tool_failure(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """Signature of a generic verifier's failure under its registered rule; never an exact
    identity.

    Rules: rule_id, rule_version, verifier_id, verifier_version, required_tool,
    required_operation, allowed_subject_kinds; one row for each verifier and version.
    """
    r = reports.join(rules, ["verifier_id", "verifier_version"], "left")
    same = F.col("tool").eqNullSafe(F.col("required_tool")) & F.col("operation").eqNullSafe(F.col("required_operation"))
    failed = F.coalesce((F.col("process_outcome") == "exited_nonzero") & (F.col("reported_result") == "failed"), F.lit(False))
    allowed = F.coalesce(F.array_contains("allowed_subject_kinds", F.col("subject.kind")), F.lit(False))
    status = (
        F.when(~failed, "not_a_failure").when(F.col("rule_id").isNull(), "unregistered_verifier_rule").when(~same, "verifier_rule_mismatch")
        .when(~stable(F.col("subject.value")), "invalid_verification_subject").when(~allowed, "verifier_subject_not_allowed").otherwise("compatible_only")
    )
    pairs = {"rule_id": F.col("rule_id"), "rule_version": F.col("rule_version"), "subject_kind": F.col("subject.kind"), "subject_value": F.col("subject.value"), "exit_class": F.lit("nonzero")}
    return _signed(r, status, pairs, {"domain": F.lit("registered_tool"), "path": F.lit("")})


def _signed(reports: DataFrame, status: Column, pairs: dict[str, Column], fields: dict[str, Column]) -> DataFrame:
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull())
    ok = F.col("status").isin("exact", "compatible_only")
    out = reports.select(*[c for c in reports.columns if c != "status"], status.alias("status"), F.map_from_entries(entries).alias("components"))
    return out.withColumn("key", F.when(ok, F.sha2(signature_key(fields, F.col("components")), 256))).withColumn("components", F.when(ok, F.col("components"))).select("report_id", "status", "components", "key")
