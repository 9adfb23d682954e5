"""Scopes, listings, joins, reports and state changes over the relational tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_any

# --- fixed values -----------------------------------------------------------
ROLE_LEVELS = {"viewer": 1, "editor": 2, "admin": 3}
ACTION_ROLES = {
    "upload_document": "editor",
    "delete_document": "editor",
    "modify_document": "editor",
    "export_documents": "editor",
    "manage_users": "admin",
    "create_user": "admin",
    "delete_user": "admin",
    "modify_user_role": "admin",
    "view_audit_logs": "admin",
    "export_audit_logs": "admin",
    "approve_access_request": "admin",
    "modify_system_settings": "admin",
    "backup_database": "admin",
    "jd_matching": "editor",
    "view_salary_data": "admin",
    "export_employee_data": "admin",
    "modify_policies": "editor",
}
# ----------------------------------------------------------------------------


def in_scope(organization: str, namespace: str, org_col: str = "organization_id", ns_col: str = "namespace") -> Column:
    """True for rows of the organisation and namespace only; null scopes never pass."""
    return F.coalesce((F.trim(F.col(org_col)) == organization) & (F.lower(F.trim(F.col(ns_col))) == namespace), F.lit(False))


def scoped(df: DataFrame, organization: str, namespace: str) -> DataFrame:
    return df.filter(in_scope(organization, namespace))


def scope_counts(df: DataFrame, organization: str, namespace: str) -> DataFrame:
    own = in_scope(organization, namespace)
    return df.agg(F.count_if(own).alias("accepted"), F.count_if(~own).alias("rejected"))


def audit_search(audit: DataFrame, organization: str | None = None, username: str | None = None, action: str | None = None, start=None, end=None, limit: int = 100, most: int = 5000) -> DataFrame:
    """Newest first. ``action`` is a pattern's inside (ASCII case ignored); an interval that ends before it
    starts is empty."""
    if organization is not None:
        audit = audit.filter(F.col("organization_id") == organization)
    if username is not None:
        audit = audit.filter(F.col("username") == username)
    if action is not None:
        audit = audit.filter(F.col("action").ilike(f"%{action}%"))
    if start is not None:
        audit = audit.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        audit = audit.filter(F.col("timestamp") <= F.lit(end))
    return audit.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(max(1, min(limit, most)))


def security_report(audit: DataFrame, organization: str, **options) -> DataFrame:
    return audit_search(audit, organization, most=1000, **options)


def newest_first(df: DataFrame, organization: str, when: str = "uploaded_at") -> DataFrame:
    return df.filter(F.col("organization_id") == organization).orderBy(F.col(when).desc(), F.col("id").desc())


def users_of(users: DataFrame, organization: str) -> DataFrame:
    """Without password hashes."""
    return users.filter(F.col("organization_id") == organization).select("id", "username", "organization_id", "role", "is_active").orderBy("username", "id")


def visible_candidates(candidates: DataFrame, organization: str, user: str, is_admin: bool) -> DataFrame:
    """An admin sees the organisation's candidates, others those they uploaded."""
    return candidates.filter((F.col("organization_id") == organization) & (F.lit(is_admin) | (F.col("uploaded_by") == user)))


def job_search(jobs: DataFrame, department: str | None = None, location: str | None = None, kind: str | None = None, least_experience: int | None = None, remote: bool | None = None, keywords: list[str] | None = None) -> DataFrame:
    """All matches; see ``page`` for a limit and the total."""
    if department:
        jobs = jobs.filter(F.lower("department") == department.lower())
    if location:
        jobs = jobs.filter(F.contains(F.lower("location"), F.lit(location.lower())))
    if kind:
        jobs = jobs.filter(F.lower("kind") == kind.lower())
    if least_experience is not None:
        jobs = jobs.filter(F.col("experience") >= least_experience)
    if remote is not None:
        jobs = jobs.filter(F.col("remote") == remote)
    if keywords:
        jobs = jobs.filter(has_any(F.lower(F.concat_ws(" ", "title", "description", "skills")), [k.lower() for k in keywords]))
    return jobs


def page(found: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows (1 to 100) in order, with the number of all as ``total``."""
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy(*order).limit(max(1, min(limit, 100))).crossJoin(F.broadcast(total))


def same_scope(df: DataFrame, **scope) -> DataFrame:
    """Rows whose columns equal the given values, nulls being equal to each other."""
    for column, value in scope.items():
        df = df.filter(F.col(column).eqNullSafe(F.lit(value)))
    return df


def scope_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with how many rows have the same scope (nulls being equal) as ``same_scope``: counts are joined back."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("same_scope")).select(*[F.col(c).alias(f"_{c}") for c in columns], "same_scope")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(counts, same).drop(*[f"_{c}" for c in columns])


def upserted_candidates(candidates: DataFrame, incoming: DataFrame) -> DataFrame:
    """An upsert by organisation, file name and uploader; rows without one of these or without a name aren't taken."""
    key = ["organization_id", "filename", "uploaded_by"]
    whole = F.lit(True)
    for c in (*key, "name"):
        whole = whole & (F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return upserted(candidates, incoming.filter(whole), key, keep=("id",))


def lookup(df: DataFrame, id_value, without: tuple[str, ...] = ()) -> DataFrame:
    return df.filter(F.col("id") == id_value).drop(*without)


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """Rows with content; scores that are null or not finite become 0."""
    score = F.when(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score"))
    return chunks.filter(F.length(F.trim("content")) > 0).withColumn("score", score)


def fresh_rows(df: DataFrame, as_of: datetime.datetime, seconds: int, when: str = "created_at") -> DataFrame:
    return df.filter(F.col(when) > F.lit(as_of - datetime.timedelta(seconds=seconds)))


def with_permission(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """Users whose role (roles: role, permissions) has the permission or all of them."""
    return users.join(roles, "role").filter(F.array_contains("permissions", "*") | F.array_contains("permissions", permission))


def allowed_actions(requests: DataFrame) -> DataFrame:
    """requests(role, action) with required_role and allowed; unknown actions need a viewer."""
    required = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTION_ROLES.items() for x in kv])[F.col("action")], F.lit("viewer"))
    levels = F.create_map(*[F.lit(x) for kv in ROLE_LEVELS.items() for x in kv])
    return requests.withColumn("required_role", required).withColumn("allowed", F.coalesce(levels[F.lower(F.trim("role"))], F.lit(0)) >= levels[F.col("required_role")])


def expired_requests(requests: DataFrame, as_of: datetime.datetime, days: int) -> DataFrame:
    old = (F.col("status") == "pending") & (F.col("created_at") < F.lit(as_of - datetime.timedelta(days=days)))
    return requests.agg(F.count_if(F.coalesce(old, F.lit(False))).alias("expired"))


def pending_requests(requests: DataFrame, users: DataFrame, organization: str) -> DataFrame:
    """Oldest first, with the user's name."""
    own = users.filter(F.col("organization_id") == organization).select(F.col("id").alias("user_id"), "username", F.col("role").alias("current_role"))
    return requests.filter("status = 'pending'").join(own, "user_id").orderBy("created_at", "id")


def stale_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests whose user no longer has the role they had when asking."""
    return requests.join(users.select(F.col("id").alias("user_id"), F.col("role").alias("current_role")), "user_id").filter("from_role <> current_role")


def messages_of(messages: DataFrame, sessions: DataFrame, username: str, organization: str, limit: int | None = None) -> DataFrame:
    """Messages of the user's own sessions, newest first."""
    own = sessions.filter((F.col("username") == username) & (F.col("organization_id") == organization)).select(F.col("id").alias("session_id"))
    rows = messages.join(own, "session_id", "left_semi")
    return rows.orderBy(F.col("id").desc()).limit(limit) if limit else rows


def appended_if_owned(messages: DataFrame, incoming: DataFrame, sessions: DataFrame, username: str, organization: str) -> DataFrame:
    """``messages`` and those incoming ones whose session is the user's own."""
    return messages.unionByName(messages_of(incoming, sessions, username, organization).select(*messages.columns))


def new_chunks(incoming: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    return incoming.join(stored.select(key), key, "left_anti")


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key; only so many leave each task."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def users_by_role(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count("*").alias("total"), F.count_if(F.col("is_active") == 1).alias("active"))


def top_actions(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.groupBy("action").agg(F.count("*").alias("uses")).orderBy(F.col("uses").desc(), "action").limit(n)


def overview(requests: DataFrame, documents: DataFrame, audit: DataFrame) -> DataFrame:
    """Five counts, one pass over each table; each side of the joins is one row."""
    a = requests.agg(F.count_if(F.col("status") == "pending").alias("pending_requests"))
    b = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "active").alias("active_documents"))
    c = audit.agg(F.count_if(F.col("action") == "view").alias("queries"), F.count_if(F.col("blocked") == 1).alias("blocked"))
    return a.crossJoin(b).crossJoin(c)


def document_stats(documents: DataFrame, organization: str) -> DataFrame:
    own = documents.filter((F.col("organization_id") == organization) & (F.col("status") != "deleted"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return own.agg(F.count("*").alias("documents"), zero("chunk_count"), zero("file_size"), zero("ocr_used"))


def active_admins(users: DataFrame) -> DataFrame:
    """Active admins by organisation; where there is one they can't be demoted, disabled or deleted."""
    return users.groupBy("organization_id").agg(F.count_if((F.col("role") == "admin") & (F.col("is_active") == 1)).alias("active_admins")).withColumn("last_admin_locked", F.col("active_admins") <= 1)


def bench_count(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_if(F.col("status") == "bench").alias("bench"), F.count("*").alias("candidates"))


def backfilled(df: DataFrame, column: str = "organization_id", value: str = "default") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(value)))


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``current`` with ``incoming`` rows in place of those with their key; columns ``keep`` retain the current
    value where there is one. Of several incoming rows for a key the last by ``updated_at`` counts."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = both.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col("updated_at").desc())))
    if keep:
        old = current.groupBy(*keys).agg(*[F.max(c).alias(f"_old_{c}") for c in keep])
        last = last.join(old, keys, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep})
    return last.filter("_nth = 1").select(*current.columns)


def decided(requests: DataFrame, users: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions(id, approved) applied to pending requests: approved, rejected, or rejected because the user's
    role has changed since."""
    joined = requests.join(decisions.select("id", "approved"), "id", "left").join(users.select(F.col("id").alias("user_id"), F.col("role").alias("current_role")), "user_id", "left")
    status = F.when((F.col("status") != "pending") | F.col("approved").isNull(), F.col("status")).when(F.col("from_role") != F.col("current_role"), "rejected").when(F.col("approved"), "approved").otherwise("rejected")
    return joined.withColumn("status", status).select(*requests.columns)


def one_pending_each(requests: DataFrame) -> DataFrame:
    """Of a user's pending requests only the first is accepted; others stay out."""
    order = Window.partitionBy("user_id", F.col("status") == "pending").orderBy("created_at", "id")
    return requests.withColumn("_nth", F.row_number().over(order)).filter((F.col("status") != "pending") | (F.col("_nth") == 1)).drop("_nth")


def changed_user(users: DataFrame, organization: str, user_id, role: str | None = None, active: int | None = None, delete: bool = False) -> DataFrame:
    """The users after a change within the organisation. The last active admin can't be taken away."""
    target = (F.col("id") == user_id) & (F.col("organization_id") == organization)
    admins = users.filter((F.col("organization_id") == organization) & (F.col("role") == "admin") & (F.col("is_active") == 1))
    others = admins.filter(F.col("id") != user_id).agg(F.count("*").alias("_others"))  # one row
    loses = (F.col("role") == "admin") & (F.col("is_active") == 1) & F.lit(delete or active == 0 or (role is not None and role != "admin"))
    rows = users.crossJoin(F.broadcast(others)).withColumn("_go", target & ~(loses & (F.col("_others") == 0)))
    if delete:
        return rows.filter(~F.col("_go")).select(*users.columns)
    new = {c: F.when(F.col("_go"), F.lit(v)).otherwise(F.col(c)) for c, v in (("role", role), ("is_active", active)) if v is not None}
    return rows.withColumns(new).select(*users.columns)


def locked_out(logins: DataFrame, failures: int = 5, minutes: int = 30) -> DataFrame:
    """logins(username, ts, ok): users with so many failures since their last success, locked until ``minutes``
    after the last."""
    since = logins.groupBy("username").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))
    failed = logins.join(since, "username").filter(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok"))))
    n = failed.groupBy("username").agg(F.count("*").alias("failures"), F.max("ts").alias("last_failure")).filter(F.col("failures") >= failures)
    return n.withColumn("locked_until", F.col("last_failure") + F.make_interval(mins=F.lit(minutes)))
