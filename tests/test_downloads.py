"""The download queue against a simulation by single seconds, however events are cut, and from a checkpoint on."""

import datetime as dt
import random

import pytest

from foliant.streaming.days import to_table
from foliant.streaming.downloads import STATE_STORE, Site, attempts

KIND = "site string, job long, book string, ts timestamp, lasts double, fails int, kind string, retry double"
START = dt.datetime(2024, 1, 1)
_T0 = int(START.replace(tzinfo=dt.timezone.utc).timestamp())


def second_by_second(jobs, until, pace, backoff, longest, tries):
    """jobs: (site, id, book, second, lasts, fails, kind, retry). Every second of every site is looked at."""
    out = []
    for site in sorted({j[0] for j in jobs}):
        mine = sorted((j for j in jobs if j[0] == site), key=lambda j: (j[3], j[1]))
        ready, tried, gone, running, last = {}, {}, set(), None, None
        for now in range(until + 1):
            while True:
                if running and running[1] == now:
                    k, _ = running
                    j, running, last = mine[k], None, now
                    if tried[k] <= (j[5] or 0):
                        if j[6] == "reader" or tried[k] >= tries:
                            gone.add(k)
                            if j[6] == "reader":
                                gone |= {i for i in ready if mine[i][2] == j[2] and i not in gone}
                        else:
                            wait = min(longest, backoff * 2 ** (tried[k] - 1))
                            if j[6] == "limit":
                                wait = max(wait, j[7] or 0)
                                for i in ready:
                                    if i not in gone:
                                        ready[i] = now + wait
                            ready[k] = now + wait
                    else:
                        gone.add(k)
                for i, j in enumerate(mine):
                    if j[3] == now and i not in ready:
                        ready[i], tried[i] = now, 0
                may = [i for i in sorted(ready) if i not in gone and ready[i] <= now and (last is None or last + pace <= now)] if not running else []
                if not may:
                    break
                k = may[0]
                tried[k] += 1
                last, running = now, (k, now + int(mine[k][4] or 0))
                failed = tried[k] <= (mine[k][5] or 0)
                out.append((site, mine[k][1], tried[k], float(now), float(running[1]), "failed" if failed and (mine[k][6] == "reader" or tried[k] >= tries) else "again" if failed else "done"))
                if running[1] > now:
                    break
    return sorted(out)


def made(seed, n=60):
    r = random.Random(seed)
    return [(r.choice("ab"), i, r.choice("xyz"), r.randrange(600), r.choice([0, 1, 5, 20, None]), r.choice([0, 0, 0, 1, 2, 9, None]), r.choice([None, "plain", "limit", "reader"]), r.choice([0, 30, 90, None])) for i in range(n)]


SETTINGS = {"pace": 3, "backoff": 4, "longest": 20, "tries": 4}


@pytest.mark.parametrize("seed", range(12))
def test_a_site_equals_the_simulation(seed):
    jobs, out = made(seed), []
    r = random.Random(seed)
    for name in "ab":
        site = Site(**SETTINGS)
        mine = sorted((j for j in jobs if j[0] == name), key=lambda j: j[3])
        line = 0
        while line < 2000:  # cut anywhere; what is known at a line are the jobs up to it
            line += r.randrange(1, 400)
            new = [j for j in mine if j[3] <= line]
            mine = [j for j in mine if j[3] > line]
            site.add([[float(j[3]), j[1], j[2], float(j[4] or 0), j[5] or 0, j[6] or "", float(j[7] or 0), float(j[3]), 0] for j in new])
            out += [(name, *x) for x in site.until(line) if x[2] <= 2000]
            site = Site(**SETTINGS, kept=site.kept())
    assert sorted(x for x in out if x[3] <= 2000) == second_by_second(jobs, 2000, **SETTINGS)


@pytest.fixture()
def timers(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_by_parts_and_from_its_checkpoint(timers, tmp_path):
    spark, jobs = timers, made(99, 80)
    # the last event only lets the watermark pass
    rows = [(s, i, b, START + dt.timedelta(seconds=t), l, f, k, w) for s, i, b, t, l, f, k, w in jobs]
    end = [("end", 0, "x", START + dt.timedelta(seconds=3000), 0.0, 0, None, 0.0)]
    bad = [(None, 1, "x", START, 0.0, 0, None, 0.0), ("a", None, "x", START, 0.0, 0, None, 0.0)]
    want = second_by_second(jobs, 3000, **SETTINGS)

    def put(part, at):
        spark.createDataFrame([(x[0], x[1], x[2], x[3], None if x[4] is None else float(x[4]), x[5], x[6], None if x[7] is None else float(x[7])) for x in part], KIND).coalesce(1).write.mode("append").parquet(at)

    def run(feed, at):
        to_table(attempts(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(feed), late="1 second", **SETTINGS), f"{at}/rows", f"{at}/checkpoint")
        got = spark.read.schema("site string, job long, tried int, started double, ended double, outcome string").parquet(f"{at}/rows").collect()
        return sorted((r["site"], r["job"], r["tried"], r["started"] - _T0, r["ended"] - _T0, r["outcome"]) for r in got if r["site"] != "end")

    put(rows + bad, f"{tmp_path}/one")
    put(end, f"{tmp_path}/one")
    first = run(f"{tmp_path}/one", f"{tmp_path}/all")
    assert (sorted(set(first) - set(want)), sorted(set(want) - set(first))) == ([], [])
    # the same in four parts, run and ended after each
    rows.sort(key=lambda x: x[3])
    for k in range(4):
        put(rows[k * 20 : (k + 1) * 20] + (end if k == 3 else []), f"{tmp_path}/parts")
        got = run(f"{tmp_path}/parts", f"{tmp_path}/cut")
    assert got == want
    assert run(f"{tmp_path}/parts", f"{tmp_path}/cut") == want  # nothing new, nothing changes


def test_the_query_equals_a_simulation_of_the_events(spark):
    from foliant.plans.queued import r5_download_attempts

    folder = "/root/testdata/sf0.001"
    events = [(r["user_id"], r["event_id"], r["event_type"], r["ts"].replace(tzinfo=dt.timezone.utc).timestamp()) for r in spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "event_type", "ts").collect()]
    line, want = max(e[3] for e in events), []
    for user in {e[0] for e in events}:
        site = Site(pace=600.0, backoff=60.0)
        site.add([[t, i, b, i % 40 * 600.0, i % 6 if i % 7 == 0 else 0, "limit" if i % 11 == 0 else "reader" if i % 13 == 0 else "plain", 7200.0, t, 0] for u, i, b, t in events if u == user])
        want += [(user, j, n, round(s, 3), round(e, 3), o) for j, n, s, e, o in site.until(int(line * 1000) / 1000)]
    got = [tuple(r) for r in r5_download_attempts(spark, folder).collect()]
    assert len(got) > 500 and sorted(got) == sorted(want)
