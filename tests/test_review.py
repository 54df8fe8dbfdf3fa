"""The log of reviews against a fold that keeps everything, one event after another."""

import random
from datetime import datetime, timedelta

import pytest

from triplicate.operators import review

EVENT = "event_id long, project_id long, at timestamp, kind string, difference_id long, group_id long, item_id string, field string, value string, document_type string, document_hash string, file_name string, file_size long"
START = datetime(2024, 1, 1)


def fold(projects, documents, differences, members, events):
    state, docs, items = dict(projects), {(p, t): h for p, t, h in documents}, {(p, i, f): v for p, _, i, f, v, _ in members}
    running, wiped = {}, {}
    status = {d[0]: "OPEN" for d in differences}
    verdicts, audit = [], []
    wiping = {p: {e["at"] for e in events if e["kind"] == "PROCESSING_COMPLETED" and e["project_id"] == p} for p in range(-1, 10)}

    def there(p, since, at):
        w = wiped.get(p)
        if since is None or since > at:
            return since is None and w is None
        return w == since or (since not in wiping[p] and (w is None or since > w)) or (at > since and (w is None or since >= w))

    for e in sorted(events, key=lambda e: (e["at"], e["event_id"])):
        p, kind, at, why = e["project_id"], e["kind"], e["at"], None
        row = lambda action, kind_, id_, old, new, bulk=False: audit.append((e["event_id"], p, action, kind_, str(id_), old, new, bulk))  # noqa: B023, E731
        final = p in state and state[p] == "FINALIZED"
        if p not in state:
            why = "Project not found"
        elif kind in review.ACTIONS:
            mine = [d for d in differences if d[0] == e["difference_id"] and d[1] == p and there(p, d[4], at)]
            why = "Discrepancy not found" if not mine else "Cannot modify a finalized project" if final else None
            if not why:
                row(kind, "Discrepancy", mine[0][0], status[mine[0][0]], review.ACTIONS[kind])
                status[mine[0][0]] = review.ACTIONS[kind]
        elif kind == "BULK_ACCEPT":
            why = "Cannot modify a finalized project" if final else None
            for d in differences:
                if not why and d[1] == p and d[3] != "Critical" and status[d[0]] == "OPEN" and there(p, d[4], at):
                    row("ACCEPT_FINDING", "Discrepancy", d[0], "OPEN", "ACCEPTED", True)
                    status[d[0]] = "ACCEPTED"
        elif kind == "OVERRIDE_DATA":
            group = [m for m in members if m[0] == p and m[1] == e["group_id"] and there(p, m[5], at)]
            why = "MatchGroup not found" if not group else "Cannot modify a finalized project" if final else None if any(m[2] == e["item_id"] for m in group) else "Item does not belong to this MatchGroup"
            if not why:
                key = (p, e["item_id"], e["field"])
                row(kind, "CanonicalLineItem", e["item_id"], items.get(key), e["value"])
                items[key] = e["value"]
                for d in differences:
                    if d[1] == p and d[2] == e["group_id"] and status[d[0]] == "OPEN" and there(p, d[4], at):
                        status[d[0]] = "SUPERSEDED"
        elif kind == "FINALIZE":
            open_ = any(d[1] == p and d[3] == "Critical" and status[d[0]] == "OPEN" and there(p, d[4], at) for d in differences)
            why = (
                "Project is already finalized" if final else "Project processing is not complete" if state[p] in ("DRAFT", "PROCESSING")
                else "Cannot finalize project with open Critical discrepancies" if open_ else None
            )
            if not why:
                row("PROJECT_FINALIZED", "Project", p, state[p], "FINALIZED")
                state[p] = "FINALIZED"
        elif kind == "REPLACE_DOCUMENT":
            key = (p, e["document_type"])
            name = (e["file_name"] or "").lower()
            why = (
                "Document not found" if key not in docs else "Legacy Purchase Order documents cannot be replaced" if key[1] == "ORDER" else "A cross-check is currently running" if running.get(p)
                else "Filename is missing" if not name else "File is empty" if not e["file_size"] else "File too large" if e["file_size"] > 200 << 20
                else "Unsupported file type" if not name.endswith(review.ENDINGS) else "The uploaded file is identical to the current document" if docs[key] == e["document_hash"] else None
            )
            if not why:
                docs[key], state[p], wiped[p] = e["document_hash"], "DRAFT", at
        elif kind in review.FACTS:
            state[p], running[p] = review.FACTS[kind], kind == "PROCESSING_STARTED"
            if kind == "PROCESSING_COMPLETED":
                wiped[p] = at
        else:
            why = "Unknown action"
        verdicts.append((e["event_id"], p, kind, why is None, why))
    kept = [(d[0], status[d[0]], there(d[1], d[4], datetime.max) if d[1] in state else True) for d in differences]
    return verdicts, kept, list(state.items()), audit


def tables(spark, projects, documents, differences, members, events):
    names = [c.split()[0] for c in EVENT.split(", ")]
    return (
        spark.createDataFrame(projects, "project_id long, status string"), spark.createDataFrame(documents, "project_id long, document_type string, document_hash string"),
        spark.createDataFrame(differences, "difference_id long, project_id long, group_id long, severity string, since timestamp"),
        spark.createDataFrame(members, "project_id long, group_id long, item_id string, field string, value string, since timestamp"),
        spark.createDataFrame([tuple(e.get(c) for c in names) for e in events], EVENT),
    )


def compared(spark, *case):
    out = review.review_log(*tables(spark, *case))
    verdicts, kept, states, audit = fold(*case)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in out.verdicts.select("event_id", "project_id", "kind", "accepted", "reason").collect()) == key(verdicts)
    assert key(tuple(r) for r in out.differences.select("difference_id", "status", "kept").collect()) == key(kept)
    assert key(tuple(r) for r in out.projects.collect()) == key(states)
    assert key(tuple(r) for r in out.audit.collect()) == key(audit)
    return verdicts


def case(seed, n_events=400):
    rng = random.Random(seed)
    projects = [(p, rng.choice(["DRAFT", "PROCESSING", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "FAILED", "FINALIZED"])) for p in range(6)]
    documents = [(p, t, rng.choice(["h1", "h2", None])) for p in range(6) for t in ("DESIGN", "ORDER", "ACKNOWLEDGEMENT") if rng.random() < 0.9]
    kinds = [*review.ACTIONS, *review.ACTIONS, "BULK_ACCEPT", "OVERRIDE_DATA", "OVERRIDE_DATA", "FINALIZE", "FINALIZE", "REPLACE_DOCUMENT", *review.FACTS, "NOTE"]
    events, completed = [], []
    for i in range(n_events):
        kind, p, at = rng.choice(kinds), rng.randint(0, 6), START + timedelta(minutes=rng.randint(0, n_events // 2))
        e = {"event_id": i, "project_id": p, "at": at, "kind": kind, "difference_id": rng.randint(0, 60), "group_id": rng.randint(0, 9), "item_id": f"i{rng.randint(0, 9)}", "field": rng.choice(["finish", "sku"]), "value": f"v{i}"}
        e |= {"document_type": rng.choice(["DESIGN", "ORDER", "ACKNOWLEDGEMENT"]), "document_hash": rng.choice(["h1", "h2", "h3"]), "file_name": rng.choice(["a.PDF", "b.xlsx", "c.exe", "", None]), "file_size": rng.choice([0, 10, 10, 10, 300 << 20])}
        completed += [(p, at)] if kind == "PROCESSING_COMPLETED" else []
        events.append(e)
    since = lambda p: rng.choice([None, None, *[t for q, t in completed if q == p], START + timedelta(minutes=rng.randint(0, n_events // 2) + 0.5)])
    differences = [(d, p := rng.randint(0, 6), rng.randint(0, 9), rng.choice(["Critical", "Warning", "Info"]), since(p)) for d in range(60)]
    members = [(p, g, f"i{i}", f, f"{p}-{g}-{i}-{f}-{n}", s) for p in range(6) for g in range(10) for i in (g, (g + 1) % 10) for n, s in enumerate({None, since(p)}) for f in ("finish",)]
    seen = {}
    members = [m for m in members if seen.setdefault((m[0], m[2], m[3]), m[1]) == m[1] and seen.setdefault((*m[:3], m[5]), m) == m]
    return projects, documents, differences, [m for m in members if m[5] is None or m[5] > START], events


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    one = case(seed)
    # A field's first value is that of the item as it was found first.
    first = {}
    for m in sorted(one[3], key=lambda m: m[5] or datetime.min):
        first.setdefault((m[0], m[2], m[3]), m[4])
    members = [(*m[:4], first[m[0], m[2], m[3]], m[5]) for m in one[3]]
    verdicts = compared(spark, *one[:3], members, one[4])
    assert len({v[4] for v in verdicts}) >= 9  # most of the reasons occur


def test_a_final_project_stays_as_it_is(spark):
    at = lambda m: START + timedelta(minutes=m)
    events = [
        {"event_id": 1, "project_id": 1, "at": at(1), "kind": "FINALIZE"}, {"event_id": 2, "project_id": 1, "at": at(2), "kind": "ESCALATE", "difference_id": 7},
        {"event_id": 3, "project_id": 1, "at": at(3), "kind": "FINALIZE"}, {"event_id": 4, "project_id": 1, "at": at(4), "kind": "ACCEPT_FINDING", "difference_id": 8},
        {"event_id": 5, "project_id": 1, "at": at(5), "kind": "FINALIZE"}, {"event_id": 6, "project_id": 1, "at": at(6), "kind": "REPLACE_DOCUMENT", "document_type": "DESIGN", "document_hash": "n", "file_name": "x.pdf", "file_size": 1},
        {"event_id": 7, "project_id": 1, "at": at(7), "kind": "ACCEPT_FINDING", "difference_id": 8},
    ]
    verdicts = compared(spark, [(1, "REVIEW_REQUIRED")], [(1, "DESIGN", "o")], [(7, 1, 1, "Critical", None), (8, 1, 1, "Warning", None)], [(1, 1, "a", "finish", "w", None)], events)
    assert [v[4] for v in verdicts] == [
        "Cannot finalize project with open Critical discrepancies", None, None, "Cannot modify a finalized project", "Project is already finalized", None, "Discrepancy not found",
    ]


def test_nothing(spark):
    assert not compared(spark, [], [], [], [], [])


def test_the_log_is_joined_by_shuffles(spark):
    """Tables of the log grow with it, whatever the size of their files, so none goes through the driver."""
    from triplicate.plans import reviews

    out = review.review_log(*reviews._tables(spark, "/root/testdata/sf0.001"))
    plans = [getattr(out, n)._jdf.queryExecution().executedPlan().toString() for n in ("verdicts", "differences", "projects", "audit")]
    assert not any("Broadcast" in p for p in plans)
