"""Density clusters, work groups and what they are called."""

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import cluster
from ..operators.graph import dot, unit_vector
from . import sqltext as S
from .registry import query, register
from .spatial_queries import GAP, SITES_SQL, report_vectors

C = F.col

CLUSTERS = f"""{SITES_SQL},
near AS (SELECT a.id AS a, b.id AS b, b.w, a.category FROM sites a JOIN sites b ON a.category = b.category AND a.id <> b.id
         AND abs(a.lat - b.lat) < 0.06e0 AND {GAP} <= 6),
core AS (SELECT s.id, s.category FROM sites s LEFT JOIN (SELECT a, sum(w) AS n FROM near GROUP BY a) k ON k.a = s.id
         WHERE s.w + coalesce(k.n, 0) >= 3),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT l.b AS id, r.root FROM reach r JOIN link l ON l.a = r.id AND r.root < l.b),
rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
rim AS (SELECT n.a AS id, min(r.root) AS root FROM near n JOIN rooted r ON r.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a),
site_root AS (SELECT * FROM rooted UNION ALL SELECT * FROM rim),
clustered AS (SELECT l.id, s.category, r.root AS cluster_id FROM (
   SELECT l.*, e.embedding AS vec FROM located l JOIN embeddings e ON e.vec_id = l.id % (SELECT count(*) FROM embeddings)) l
   JOIN sites s ON s.category = l.issue_category AND s.lat = l.lat AND s.lon = l.lon AND s.vec = l.vec
   JOIN site_root r ON r.id = s.id)"""


def clustered(v):
    return cluster.demand_groups(report_vectors(v))


@query("clu_01_density_clusters", "CLU-01", "id:i category:s cluster_id:i",
       f"WITH {CLUSTERS} SELECT id, category, cluster_id FROM clustered", "located")
def density(v):
    return clustered(v)


_AB = S.hav("a.lat", "a.lon", "b.lat", "b.lon")
LINKAGE = f"""spots AS (SELECT group_id, lat, lon, min(id) AS id FROM grouped GROUP BY 1, 2, 3),
lnk AS (SELECT a.id AS a, b.id AS b FROM spots a JOIN spots b ON a.group_id = b.group_id AND a.id <> b.id AND {_AB} * 1000 <= 250),
rch AS (SELECT id, id AS root FROM spots UNION SELECT l.b AS id, r.root FROM rch r JOIN lnk l ON l.a = r.id AND r.root < l.b),
rt AS (SELECT id, min(root) AS root FROM rch GROUP BY id),
wg AS (SELECT g.*, rt.root FROM grouped g JOIN spots s ON s.group_id = g.group_id AND s.lat = g.lat AND s.lon = g.lon JOIN rt ON rt.id = s.id)"""


def groups_of(v):
    return cluster.work_groups(v.grouped, "group_id", DEFAULTS.work_group_m)


@query("clu_02_single_linkage", "CLU-02", "id:i group_id:i root:i part:i",
       f"""WITH {LINKAGE} SELECT id, group_id, root, dense_rank() OVER (PARTITION BY group_id ORDER BY root) - 1 AS part FROM wg""",
       "grouped")
def linkage(v):
    roots = groups_of(v)
    return roots.join(cluster.number_groups(roots, ["group_id"], "part"), ["group_id", "root"])


@query("clu_03_work_groups", "CLU-03",
       "group_id:i root:i label:s centroid_lat:d centroid_lon:d report_count:i distinct_reporters:i spread_m:d sample_text:s location_basis:s",
       f"""WITH {LINKAGE}, c AS (SELECT group_id, root, avg(lat) AS clat, avg(lon) AS clon FROM wg GROUP BY 1, 2),
       md AS (SELECT group_id, root, village FROM (SELECT group_id, root, village, row_number() OVER (PARTITION BY group_id, root ORDER BY count(*) DESC, min(id)) AS rn
              FROM wg WHERE village <> '' GROUP BY 1, 2, 3) WHERE rn = 1),
       mb AS (SELECT group_id, root, block FROM (SELECT group_id, root, block, row_number() OVER (PARTITION BY group_id, root ORDER BY count(*) DESC, min(id)) AS rn
              FROM wg WHERE block <> '' GROUP BY 1, 2, 3) WHERE rn = 1)
       SELECT wg.group_id, wg.root, coalesce(min(md.village), min(mb.block), 'Unnamed location') AS label, min(clat) AS centroid_lat, min(clon) AS centroid_lon,
         count(*) AS report_count, count(DISTINCT CASE WHEN user_id IS NOT NULL THEN 'account:' || user_id ELSE 'text:' || lower(trim(coalesce(raw_text, ''))) END) AS distinct_reporters,
         {S.rnd('max(' + S.hav('clat', 'clon', 'wg.lat', 'wg.lon') + ') * 1000', 1)} AS spread_m,
         substr(arg_max(coalesce(raw_text, ''), struct_pack(n := length(coalesce(raw_text, '')), i := -id)), 1, 300) AS sample_text,
         CASE WHEN bool_and(precise_lat IS NOT NULL AND precise_lon IS NOT NULL) THEN 'citizen_gps_pin'
              WHEN bool_or(precise_lat IS NOT NULL AND precise_lon IS NOT NULL) THEN 'mixed' ELSE 'village_centroid' END AS location_basis
       FROM wg JOIN c USING (group_id, root) LEFT JOIN md USING (group_id, root) LEFT JOIN mb USING (group_id, root) GROUP BY wg.group_id, wg.root""",
       "grouped")
def described(v):
    members = v.grouped.join(groups_of(v).select("id", "root"), "id")
    return cluster.describe_work_groups(members, "group_id")


_PF = S.hav("c.lat", "c.lon", "f.p_lat", "f.p_lon")


@query("clu_04_named_groups", "CLU-04", "gid:i asset_label:s asset_source:s asset_external_id:s shortlist:i",
       f"""WITH c AS (SELECT group_id, min(category) AS category, min(lat) AS lat, min(lon) AS lon, min(village) AS village FROM
             (SELECT ce.*, p.name AS village FROM centres ce JOIN places p ON p.id = ce.group_id % 149) GROUP BY group_id),
           w AS (SELECT p.name AS village, count(*) AS n, min(w.work_name) AS nm, min(cast(w.external_id AS VARCHAR)) AS xid FROM works w JOIN places p ON p.id = w.place_id GROUP BY 1),
           f AS (SELECT c.group_id, count(*) AS n, min(f.name) AS nm, min(f.external_id) AS xid, min(f.source) AS src FROM c JOIN facilities f
                 ON f.category = c.category AND c.category <> 'road' AND {_PF} <= 2 GROUP BY 1)
           SELECT c.group_id AS gid, CASE WHEN w.n = 1 THEN w.nm WHEN f.n = 1 THEN f.nm END AS asset_label,
             CASE WHEN w.n = 1 THEN 'pmgsy' WHEN f.n = 1 THEN f.src END AS asset_source,
             CASE WHEN w.n = 1 THEN w.xid WHEN f.n = 1 THEN f.xid END AS asset_external_id, least(6, coalesce(w.n, f.n, 0)) AS shortlist
           FROM c LEFT JOIN w ON c.category = 'road' AND w.village = c.village LEFT JOIN f USING (group_id)""",
       "centres places works facilities")
def named(v):
    groups = v.sql("SELECT c.group_id AS gid, c.category AS cat, c.lat AS centroid_lat, c.lon AS centroid_lon, p.name AS village"
                   " FROM {centres} c JOIN {places} p ON p.id = c.group_id % 149")
    out = cluster.name_work_groups(groups, "cat", v.facilities, cluster.works_by_village(v.works, v.places))
    return out.withColumn("shortlist", F.coalesce(F.size("candidates"), F.lit(0)))


register(
    "clu_05_unit_vectors", "CLU-05", "vec_id:i length:d first:d",
    lambda v: v.embeddings.select("vec_id", unit_vector(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u")).select(
        "vec_id", F.sqrt(dot(C("u"), C("u"))).alias("length"), F.element_at("u", 1).alias("first")),
    """SELECT vec_id, 1e0 AS length, CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS first
       FROM embeddings""")
