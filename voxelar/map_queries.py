"""More operators of the map applied to the given tables: frame trees, rasters, density clusters, suppression in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelar.functions import detection, geometry
from voxelar.operators import asof, boxes, density, finalize, frames, layout, raster, voxels
from voxelar.plans.counters import RunCounters
from voxelar.plans.cut import materialize, new_path
from voxelar.queries import _DIST2, _LAYOUT, NMS, ORACLES, VOXEL, E, P, V, _clean_objects, events, nms_boxes, points, query, read, rounded
from voxelar.sources import recordings, snapshots
from voxelar.streaming import joins, live, quarantine

#: A chain of moving edges with samples of their own, and two fixed frames.
_EDGES = (("map", "odom", "view"), ("odom", "base", "click"), ("base", "arm", "signup"))
_FIXED = (("arm", "camera", 0.5, 0.25), ("base", "lidar", -1.5, 1.0))
#: Frames of a lookup by ``event_id % 4``: along the chain, a part of it, back down beside it, and from a frame that nothing holds.
_LOOKUPS = (("camera", "map"), ("camera", "base"), ("map", "lidar"), ("camera", "moon"))
_GAP = 43_200_000_000_000


def _edge(child: str, event_type: str) -> str:
    """SQL of one edge's planar pose at each lookup, between the samples on either side."""
    part = "case when hi = lo then 0 else (s.ns - lo) / (hi - lo)::double end"
    side = lambda n, at: f"left join sample {n} on {n}.ns = s.{at} and {n}.robot = s.robot and {n}.event_type = '{event_type}'"
    return f"""{child} as (select s.event_id, {", ".join(f"a.{c} + (b.{c} - a.{c}) * {part} as {c}" for c in ("x", "y", "z", "yaw"))} from (
  select l.event_id, l.ns, l.robot, max(p.ns) filter (p.ns <= l.ns) as lo, min(p.ns) filter (p.ns >= l.ns) as hi
  from look l left join sample p on p.robot = l.robot and p.event_type = '{event_type}' and abs(p.ns - l.ns) <= {_GAP} group by all) s {side("a", "lo")} {side("b", "hi")})"""


def _product(name: str, first: str, second: str) -> str:
    """SQL of the product of two planar poses."""
    return f"""{name} as (select p.event_id, p.x + cos(p.yaw) * q.x - sin(p.yaw) * q.y as x, p.y + sin(p.yaw) * q.x + cos(p.yaw) * q.y as y,
  p.z + q.z as z, p.yaw + q.yaw as yaw from {first} p join {second} q using (event_id))"""


_CHAIN = ",\n".join(
    [
        *[_edge(child, kind) for _, child, kind in _EDGES],
        *[f"{child} as (select event_id, {x}::double as x, 0.0::double as y, {z}::double as z, pi() / 2 as yaw from look)" for _, child, x, z in _FIXED],
        _product("t1", "odom", "base"),
        _product("t2", "arm", "camera"),
        _product("t3", "t1", "t2"),
        _product("t4", "t1", "lidar"),
        "back as (select event_id, -(cos(yaw) * x + sin(yaw) * y) as x, sin(yaw) * x - cos(yaw) * y as y, -z as z, -yaw as yaw from t4)",
    ]
)


@query(f"""with {E}, ranked as (select *, user_id % 4 as robot from ev),
sample as (select robot, event_type, ns, event_id % 100 / 10.0::double as x, event_id % 70 / 10.0::double as y, event_id % 50 / 10.0::double as z, event_id % 5 * pi() / 6 as yaw
  from ranked where event_type in ('view', 'click', 'signup')),
look as (select event_id, robot, ns, event_id % 4 as kind from ranked where event_type = 'error'), {_CHAIN},
found as (select look.event_id, case kind when 0 then t3 when 1 then t2 when 2 then back end as p
  from look join t3 using (event_id) join t2 using (event_id) join back using (event_id))
select event_id, round(p.x, 6) + 0.0 as x, round(p.y, 6) + 0.0 as y, round(p.z, 6) + 0.0 as z, round(cos(p.yaw), 6) + 0.0 as turn_x, round(sin(p.yaw), 6) + 0.0 as turn_y from found""")
def frame_transforms(spark, sf_dir):
    """Poses along paths of four robots' trees: three moving edges at different rates and fixed ones, up, down and unknown."""
    e = events(spark, sf_dir).withColumn("robot", F.col("user_id") % 4)
    yaw = F.col("event_id") % 5 * (3.141592653589793 / 6)
    turn = [F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(yaw / 2).alias("qz"), F.cos(yaw / 2).alias("qw")]
    shift = [(F.col("event_id") % m / 10.0).alias(a) for a, m in zip("xyz", (100, 70, 50), strict=True)]
    case = F.coalesce(*[F.when(F.col("event_type") == kind, F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"))) for p, c, kind in _EDGES])
    moving = e.withColumn("edge", case).where("edge is not null").select("robot", "edge.parent", "edge.child", "ns", *shift, *turn)
    robots = e.select("robot").distinct()
    half = 0.5**0.5
    still = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.lit(x).alias("x"), F.lit(z).alias("z")) for p, c, x, z in _FIXED])
    fixed = robots.select("robot", F.explode(still).alias("f")).select(
        "robot", "f.parent", "f.child", "f.x", F.lit(0.0).alias("y"), "f.z", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(half).alias("qz"), F.lit(half).alias("qw")
    )
    ends = F.element_at(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in _LOOKUPS]), (F.col("event_id") % 4 + 1).cast("int"))
    asked = e.where("event_type = 'error'").select(F.col("event_id").alias("lookup"), "robot", ends.alias("p"), "ns").select("lookup", "robot", "p.*", "ns")
    found = frames.lookup_transforms(asked, moving, fixed, _GAP, ["robot"])
    planar = found.select(F.col("lookup").alias("event_id"), "x", "y", "z", (1 - 2 * F.col("qz") * F.col("qz")).alias("turn_x"), (2 * F.col("qz") * F.col("qw")).alias("turn_y"))
    return planar.select("event_id", *rounded("x", "y", "z", "turn_x", "turn_y"))


def _pixel(x: str, y: str, u: str, v: str) -> str:
    return f"""greatest(0, least(width - 1, round_even(({x} - min_x) * scale + offset_x, 0)))::integer as {u},
  greatest(0, least(height - 1, round_even(height - 1 - (({y} - min_y) * scale + offset_y), 0)))::integer as {v}"""


@query(f"""with {P}, {_LAYOUT},
placed as (select label as rank, vec_id as ord, vec_id * 7919 % 16777216 as rgb, width, height, {_pixel("x", "y", "u", "v")} from pts, fit),
drawn as (select greatest(0, least(width - 1, u + i)) as u, greatest(0, least(height - 1, v + j)) as v, rgb, (0, rank, n, ord) as draw
  from placed, (values (0, 0, 0), (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)) t(n, i, j)),
box as (select label as rank, label * 1000003 % 16777216 as rgb, {_pixel("min(x)", "min(y)", "u1", "v2")}, {_pixel("max(x)", "max(y)", "u2", "v1")} from pts, fit group by label, min_x, min_y, scale, offset_x, offset_y, width, height),
ring as (select rank, rgb, u1 + d as u1, v1 + d as v1, u2 - d as u2, v2 - d as v2 from box, range(2) t(d) where u1 + d <= u2 - d and v1 + d <= v2 - d),
line as (select rank, rgb, unnest(range(u1, u2 + 1)) as u, v1 as v from ring union all select rank, rgb, unnest(range(u1, u2 + 1)), v2 from ring
  union all select rank, rgb, u1, unnest(range(v1, v2 + 1)) from ring union all select rank, rgb, u2, unnest(range(v1, v2 + 1)) from ring),
every as (select u, v, rgb, draw from drawn union all select u, v, rgb, (1, rank, 0, 0) from line)
select u::integer as u, v::integer as v, max_by(rgb, draw)::bigint as rgb from every group by 1, 2""")
def top_down_raster(spark, sf_dir):
    """All clouds and the outlines of their boxes as pixels of one picture."""
    p = points(spark, sf_dir)
    fit = layout.fit_layout(p)
    dots = raster.point_pixels(p, fit, F.col("label"), "vec_id", F.col("vec_id") * 7919 % 16777216)
    bounds = p.groupBy("label").agg(*[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    return raster.raster(dots, raster.box_pixels(bounds, fit, F.col("label"), F.col("label") * 1000003 % 16777216))


_DENSE = f"""with recursive {P}, near as (select a.vec_id as a, b.vec_id as b, {_DIST2} as d2 from pts a join pts b on a.label = b.label where {_DIST2} < 0.12::double * 0.12::double),
core as (select a from near group by a having count(*) >= 4),
link as (select n.a, n.b from near n join core x on n.a = x.a join core y on n.b = y.a),
reach(a, b) as (select a, a from core union select r.a, l.b from reach r join link l on r.b = l.a),
lab as (select a, min(b) as cluster from reach group by a),
bord as (select n.a, min_by(n.b, (n.d2, n.b)) as c from near n join core y on n.b = y.a where n.a not in (select a from core) group by n.a)"""
_LABELS = """select pts.label, vec_id, lab.a is not null as core, coalesce(lab.cluster, other.cluster) as cluster
from pts left join lab on vec_id = lab.a left join bord on vec_id = bord.a left join lab other on bord.c = other.a"""


@query(f"{_DENSE} {_LABELS}")
def density_clusters(spark, sf_dir):
    return density.density_clusters(points(spark, sf_dir), 0.12, 4, "vec_id", ["label"]).select("label", "vec_id", "core", "cluster")


@query(NMS)
def nms_rounds(spark, sf_dir):
    """The boxes of ``nms`` by rounds of local maxima."""
    return boxes.suppress_rounds(nms_boxes(spark, sf_dir), 0.45, ["frame_id", "class_name"])


#: Messages of a session come in the order of their ids: views and clicks are depth frames, all else detections.
_LIVE = {"size": 8, "reach_ns": 21_600_000_000_000}


def _live(spark, sf_dir, delay: int):
    """The pairing as a stream over files of messages in order of arrival, one trigger after the other."""
    e = events(spark, sf_dir)
    named = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("arrival"), "ns", F.col("event_type").isin("view", "click").alias("is_depth"))
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source, out = new_path(spark, "messages"), new_path(spark, "pairs")
    bounds = named.agg(F.min("arrival"), F.max("arrival")).first()
    step = (bounds[1] - bounds[0]) // 3 + 1
    for part in range(3):
        some = named.where(F.expr(f"(arrival - {bounds[0]}) div {step} = {part}"))
        some.repartition(lanes, "session").write.mode("append").parquet(source)
    stream = spark.readStream.schema(named.schema).option("maxFilesPerTrigger", lanes).parquet(source)
    with live.rocksdb_state(spark):
        started = live.live_pairs(stream, **_LIVE, delay=delay).writeStream.option("checkpointLocation", new_path(spark, "offsets"))
        started.outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(live.OUTCOMES).parquet(out)


@query(f"""with {E}, m as (select user_id::varchar as session, event_id as arrival, ns, event_type in ('view', 'click') as is_depth from ev),
depth as (select *, row_number() over (partition by session order by arrival) as k from m where is_depth),
det as (select *, row_number() over (partition by session order by arrival) as j from m where not is_depth),
trig as (select t.session, d.arrival, d.ns, (select max(j) from det x where x.session = t.session and x.arrival < t.arrival) as last
  from depth t join depth d on d.session = t.session and d.k = t.k - 2),
pair as (select t.session, t.arrival, t.ns, x.arrival as detection, x.ns as detection_ns, abs(x.ns - t.ns) as gap_ns
  from trig t join det x on x.session = t.session and x.j > t.last - {_LIVE["size"]} and x.j <= t.last
  qualify row_number() over (partition by t.session, t.arrival order by abs(x.ns - t.ns), x.arrival) = 1),
matched as (select * from pair where gap_ns <= {_LIVE["reach_ns"]}),
gone as (select d.session, d.arrival, d.ns from depth d join (select session, max(k) as n from depth group by 1) using (session)
  left join matched x on x.session = d.session and x.arrival = d.arrival where d.k <= n - {_LIVE["size"]} and x.arrival is null)
select session, arrival, ns, 'matched' as outcome, 'depth' as trigger, detection, detection_ns, gap_ns from matched
union all select session, arrival, ns, 'evicted', 'depth', null, null, null from gone""")
def live_delayed(spark, sf_dir):
    """Frames handled two frames late, so no detection triggers a match."""
    return _live(spark, sf_dir, 2)


@query()
def live_retried(spark, sf_dir):
    """Frames handled as they come, and again when a later detection is near."""
    return _live(spark, sf_dir, 0)


def _objects(spark, sf_dir):
    """Cleaned objects as a snapshot takes them: a record and the points of each."""
    p = _clean_objects(spark, sf_dir)
    name = F.concat(F.lit("class_"), F.col("label").cast("string"))
    records = layout.object_records(p, "label", name).withColumnsRenamed({"label": "class_name"})
    stem = F.concat(F.format_string("objects/object_%04d_", F.col("track_id")), detection.safe_name(F.col("class_name")))
    records = records.select("track_id", "class_name", "point_count", F.concat(stem, F.lit(".ply")).alias("point_cloud_ply"), F.concat(stem, F.lit(".npz")).alias("point_cloud_npz"))
    clouds = p.groupBy(F.col("label").alias("track_id")).agg(F.collect_list(F.struct(*geometry.AXES)).alias("points"))  # a file is one object's
    return records.join(clouds, "track_id").select("track_id", F.to_json(F.struct(*records.columns)).alias("record"), "points")


@query(f"""with {P}, {V}, o as (select label, count(*) as n from (select label, kx, ky, kz from vox group by all) group by label having label < 7)
select label as track_id, 'class_' || label as class_name, n as point_count, n as vertices, true as has_npz, 'object_' || lpad(label::varchar, 4, '0') || '_class_' || label || '.ply' as file from o""")
def object_snapshots(spark, sf_dir):
    """Two snapshots in one folder, the second of fewer objects: its records with the files they name."""
    folder = new_path(spark, "snapshot")
    every = _objects(spark, sf_dir)
    snapshots.write_snapshot(every, folder)
    snapshots.write_snapshot(every.where("track_id < 7"), folder)
    ply = snapshots.snapshot_files(spark, folder).withColumn("head", F.decode(F.substring("content", 1, 256), "ISO-8859-1"))
    ply = ply.select(F.col("file").alias("point_cloud_ply"), F.regexp_extract("head", r"element vertex (\d+)", 1).cast("long").alias("vertices"))
    npz = snapshots.snapshot_files(spark, folder, "npz").select(F.col("file").alias("point_cloud_npz"), F.lit(True).alias("has_npz"))
    named = snapshots.read_snapshot(spark, folder).join(ply, "point_cloud_ply", "full_outer").join(npz, "point_cloud_npz", "left")
    return named.select("track_id", "class_name", "point_count", "vertices", "has_npz", F.substring_index("point_cloud_ply", "/", -1).alias("file"))


@query("select epoch_us(ts) * 1000 as stamp_ns, event_id, props from events")
def recording_replay(spark, sf_dir):
    """Every event as a recorded message, read back as a stream in batches of a limited number of messages."""
    e = events(spark, sf_dir)
    folder, out = new_path(spark, "recording"), new_path(spark, "replayed")
    named = e.select(F.format_string("%09d", F.expr("event_id div 2000")).alias("file"), F.col("ns").alias("stamp_ns"), F.to_json(F.struct("event_id", "props")).cast("binary").alias("data"))
    recordings.record(named, folder)
    stream = recordings.recording_stream(spark, folder, new_path(spark, "progress") + "/offset.json", named.count() // 3 + 1)
    started = stream.writeStream.option("checkpointLocation", new_path(spark, "offsets")).start(out)
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    found = spark.read.schema(recordings.SCHEMA).parquet(out).withColumn("m", F.from_json(F.col("data").cast("string"), "event_id long, props string"))
    return found.select("stamp_ns", "m.event_id", "m.props")


@query(ORACLES["voxel_outer_merge"])
def voxel_stored_merge(spark, sf_dir):
    """``voxel_outer_merge`` of two tables stored in the order of their codes."""
    p, folder = points(spark, sf_dir), new_path(spark, "voxels")
    names = [f"voxels_{uuid.uuid4().hex}" for _ in range(2)]
    for i, name in enumerate(names):
        voxels.store_voxels(p.where(F.col("label") % 2 == i), VOXEL, name, path=folder)
    return voxels.merge_stored(spark, *names, VOXEL).select(*voxels.CELLS, "shared", *rounded("x", "y", "z"))


@query(f"""{_DENSE}, named as ({_LABELS}), sz as (select label, cluster, count(*) as m from named where cluster is not null group by all),
best as (select label, max_by(cluster, (m, -cluster)) as top, max(m) as m from sz group by label), tot as (select label, count(*) as n from pts group by label),
gone as (select count(*) as k from named join tot using (label) left join best using (label) where not (top is null or m < 5 or n < 4 or coalesce(cluster = top, false)))
select (select count(*) from pts) as raw, (select count(*) from (select distinct label, floor(x / {VOXEL}::double), floor(y / {VOXEL}::double), floor(z / {VOXEL}::double) from pts)) as voxels,
  k as cluster_removed from gone""")
def run_counters(spark, sf_dir):
    """Raw, voxel and cluster-removed numbers of points, counted while the points are cleaned."""
    seen = RunCounters()
    p = seen.watch(points(spark, sf_dir), "raw")
    stored = materialize(p, "points")
    kept = density.largest_density_cluster(stored, 0.12, 4, "vec_id", ["label"])
    marked = materialize(seen.watch(kept, "cleaned", kept=F.count_if("kept")), "cleaned")
    cells = voxels.voxel_mean(stored.join(marked.select("vec_id"), "vec_id"), VOXEL, ["label"])
    seen.watch(cells, "voxels").write.format("noop").mode("overwrite").save()
    return seen.row(spark).select("raw", "voxels", (F.col("cleaned") - F.col("cleaned_kept")).alias("cluster_removed"))


#: Clouds come in order of their ids, metadata of two thirds of them up to two batches apart; a last stamp on both sides closes the stream.
_DELAY_H, _LAST = 480, 4_000_000_000_000_000_000
_MESSAGES = """all_m as (select 'cloud' as side, event_id as ref, ns as stamp_ns, event_id % 3 as part from ev
  union all select 'meta', event_id, ns, event_id * 7 % 11 % 3 from ev where event_id % 5 <> 0)"""


@query(f"""with {E}, {_MESSAGES}, top as (select part, max(stamp_ns) as t from all_m group by part),
mark as (select p.part, (select max(t) from top where top.part < p.part) // 1000000 - {_DELAY_H} * 3600000 as w from top p),
flagged as (select side, ref, stamp_ns, coalesce(stamp_ns // 1000000 <= w, false) as late from all_m join mark using (part)),
c as (select * from flagged where side = 'cloud' and not late), m as (select * from flagged where side = 'meta' and not late)
select side, ref, stamp_ns, 'late' as outcome from flagged where late
union all select 'cloud', c.ref, c.stamp_ns, case when m.ref is null then 'no metadata' else 'matched' end from c left join m on c.stamp_ns = m.stamp_ns
union all select 'meta', m.ref, m.stamp_ns, case when c.ref is null then 'no cloud' else 'matched' end from m left join c on c.stamp_ns = m.stamp_ns""")
def stamp_quarantine(spark, sf_dir):
    """Two streams: rows are told late from punctual ones, then punctual ones are joined; every message gets one outcome."""
    e = events(spark, sf_dir)
    i = F.col("event_id")
    clouds = e.select(F.lit("cloud").alias("side"), i.alias("ref"), F.col("ns").alias("stamp_ns"), (i % 3).alias("part"))
    metas = e.where(i % 5 != 0).select(F.lit("meta").alias("side"), i.alias("ref"), F.col("ns").alias("stamp_ns"), (i * 7 % 11 % 3).alias("part"))
    every = clouds.unionByName(metas)
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source, staged, out = (new_path(spark, n) for n in ("messages", "staged", "pairs"))
    for part in range(3):
        every.where(F.col("part") == part).drop("part").repartition(lanes).write.mode("append").parquet(source)
    last = spark.range(2).select(F.when(F.col("id") == 0, "cloud").otherwise("meta").alias("side"), F.lit(-1).cast("long").alias("ref"), F.lit(_LAST).alias("stamp_ns"))
    last.coalesce(1).write.mode("append").parquet(source)
    messages = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", lanes).parquet(source)
    sink = quarantine.flagging(spark, staged, new_path(spark, "marks"), _DELAY_H * 3_600_000)
    joins.snapshots(messages, sink, new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    second = quarantine.paired(quarantine.flagged(spark, staged, stream=True), f"{_DELAY_H} hours").writeStream
    second = second.outputMode("append").option("checkpointLocation", new_path(spark, "offsets"))
    second.trigger(availableNow=True).start(out).awaitTermination()
    found = quarantine.outcomes(quarantine.flagged(spark, staged), spark.read.parquet(out))
    return found.where(F.col("stamp_ns") < _LAST)


@query(f"""with {E}, l as (select *, user_id % 80 as class_id from ev where event_type = 'error'), w as (select * from ev where event_type = 'view'),
j as (select l.event_id, w.event_id * 7919 % 16777216 as rgb, row_number() over (partition by l.event_id order by abs(w.ns - l.ns), w.event_id) as k
  from l join w on l.user_id = w.user_id and abs(w.ns - l.ns) <= 3600000000000),
c as (select l.event_id, rgb, ((class_id + 1) * 2654435761) % 4294967296 as h from l left join j on l.event_id = j.event_id and k = 1)
select event_id, coalesce(rgb, (((h & 191) + 64) << 16) | ((((h >> 8) & 191) + 64) << 8) | (((h >> 16) & 191) + 64))::bigint as rgb,
  case when rgb is null then 'class_fallback' else 'camera_rgb' end as color_mode from c""")
def color_fallback(spark, sf_dir):
    """Errors take the colour of the nearest view of their user within an hour, else that of their class."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ns", (F.col("user_id") % 80).alias("class_id"))
    images = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("image"), F.col("ns").alias("image_ns"), (F.col("event_id") * 7919 % 16777216).alias("rgb"))
    return asof.colored(left, images, "event_id", "ns", "image_ns", "image", 3_600_000_000_000, ["user_id"]).select("event_id", "rgb", "color_mode")


@query("""with s as (select event_id, event_id % 4 * 120 as h, (user_id % 3 - 1) * 320 as w, event_id % 7 as kind from events)
select event_id, (case when kind > 1 and h > 0 and w > 0 then w else 640 end)::integer as width, (case when kind > 1 and h > 0 and w > 0 then h else 480 end)::integer as height from s""")
def payload_sizes(spark, sf_dir):
    """Sizes from payloads: none, too short, not positive, with channels."""
    e = read(spark, sf_dir, "events")
    h, w, kind = F.col("event_id") % 4 * 120, (F.col("user_id") % 3 - 1) * 320, F.col("event_id") % 7
    shape = F.when(kind == 1, F.array(h)).when(kind > 1, F.array(h, w, F.lit(3).cast("long")))
    return e.select("event_id", detection.image_size(shape, (640, 480)).alias("s")).select("event_id", "s.width", "s.height")


@query("""select cloud, id, row_number() over (partition by cloud order by id) - 1 as position
from (select distinct l_orderkey % 1000 as cloud, l_suppkey as id from lineitem where l_linenumber < 6)""")
def cloud_detections(spark, sf_dir):
    """Lines are points of a thousand clouds, suppliers their detections."""
    points_ = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("cloud"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")).alias("id"))
    return finalize.detection_ids(points_, "id", ["cloud"])


@query("""select event_id, event_id // 40 as frame, row_number() over (partition by event_id // 40 order by round(value / 10, 0) desc nulls last, event_id) - 1 as position from events""")
def score_order(spark, sf_dir):
    """Events in frames of forty by a coarse score with many ties."""
    e = read(spark, sf_dir, "events").select("event_id", F.expr("event_id div 40").alias("frame"), F.round(F.col("value") / 10, 0).alias("score"))
    return boxes.score_order(e, "score", "event_id", ["frame"]).select("event_id", "frame", "position")


@query("""with f as (select event_id // 20 as frame, list(event_id order by event_id) as d, list(user_id order by event_id) filter (event_type <> 'error') as m from events group by 1)
select frame, (i - 1)::integer as detection_id, d[i] as detection, m[i] as mask from f, range(1, 21) t(i) where i <= len(d) and i <= coalesce(len(m), 0)""")
def mask_zip(spark, sf_dir):
    """Frames of twenty detections, whose masks are fewer, paired by place."""
    e = read(spark, sf_dir, "events").groupBy(F.expr("event_id div 20").alias("frame"))
    ordered = [F.sort_array(F.collect_list(F.when(c, F.struct("event_id", "user_id")))) for c in (F.lit(True), F.col("event_type") != "error")]
    frames_ = e.agg(*[a.alias(n) for a, n in zip(ordered, "dm", strict=True)]).select("frame", F.col("d.event_id").alias("d"), F.col("m.user_id").alias("m"))
    return boxes.with_masks(frames_, "d", "m", ["frame"])
