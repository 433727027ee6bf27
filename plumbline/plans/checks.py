"""The checks: each takes a context and returns findings. They decide severities; the measurements are plans in ``operators``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, probes, relational, splitting, statistics
from ..sources.images import NO_DECODER
from .findings import Finding, Severity, check

PASS, INFO, WARN, BLOCKER = Severity

_COLOURS = [f"{kind}_{channel}" for kind in ("mean", "std") for channel in "rgb"]
_LOOKS = ["brightness", "contrast", "saturation", "sharpness", "entropy", "clipped_frac", "edge_density"]
_SIZES = ["width", "height", "bytes"]
#: Features that are compared between splits, and between classes.
DRIFT_FEATURES, CLASS_FEATURES = [*_SIZES, *_LOOKS, *_COLOURS, "jpeg_quality"], [*_LOOKS, *_COLOURS, *_SIZES]


def cell(value) -> str:
    """A value in a table: thousands set apart, fractions to three digits, bars escaped."""
    match value:
        case bool() | None:
            return str(value)
        case int():
            return format(value, ",")
        case float():
            return format(value, ",.0f" if abs(value) >= 1000 else ",.3g")
    return str(value).replace("|", r"\|")


def md_table(head, rows) -> str:
    """A Markdown table."""
    body = [list(head), ["---"] * len(head), *([cell(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(line)} |" for line in body)


def percent(part: float, whole: float) -> float:
    return round(100 * part / whole, 2) if whole else 0.0


def skip(reason: str) -> tuple:
    return PASS, f"Skipped: {reason}", {"skipped": reason}


def rows(df: DataFrame, *order, most: int | None = None) -> list:
    """Rows of a small table, or the first ``most`` of a large one."""
    df = df.orderBy(*order) if order else df
    return (df.limit(most) if most is not None else df).collect()


def examples(ctx, df: DataFrame, note=None, *order) -> list[str]:
    df = df.select("relpath", (note if note is not None else F.lit(None)).alias("note"))
    return [f"{r.relpath}  ({r.note})" if r.note is not None else r.relpath for r in rows(df, *(order or ("relpath",)), most=ctx.max_examples)]


def ordered_examples(ctx, df: DataFrame, by, note) -> list[str]:
    return [f"{r.relpath}  ({r.note})" for r in df.orderBy(by, "relpath").select("relpath", note.alias("note")).limit(ctx.max_examples).collect()]


# Integrity


@check("int.unreadable", "Files that can't be decoded", "any: BLOCKER; of a kind without a decoder here: INFO", "integrity")
def unreadable(ctx):
    unknown = F.coalesce(F.col("error").startswith(NO_DECODER), F.lit(False))
    bad, undecoded = ctx.df.where(~F.col("readable") & ~unknown), ctx.df.where(~F.col("readable") & unknown)
    n, left = ctx.df.agg(F.count_if(~F.col("readable") & ~unknown), F.count_if(~F.col("readable") & unknown)).first()
    out = []
    if n:
        reasons = rows(audits.error_reasons(ctx.df.where(~unknown)), F.desc("n"), "reason")
        out.append((BLOCKER, f"{n:,} of {ctx.n:,} files can't be decoded", {"unreadable": n, "pct": percent(n, ctx.n)}, examples(ctx, bad, F.col("error")), "Export these files again or drop them; loaders fail on them or skip them silently.", md_table(["reason", "files"], reasons)))
    if left:
        out.append((INFO, f"{left:,} whole files are of a kind that isn't decoded here; their pixels were not looked at", {"undecoded": left}, examples(ctx, undecoded, F.col("error")), "Check them with another decoder, or convert them."))
    return out or [(PASS, f"All {ctx.n:,} files decode")]


@check("int.format_mismatch", "Extensions that belie the content", "any: WARN", "integrity")
def format_mismatch(ctx):
    kinds = rows(audits.format_mismatches(ctx.df), F.desc("n"), "mismatch")
    if not kinds:
        return [(PASS, "Extensions agree with the contents")]
    n = sum(r.n for r in kinds)
    return [(WARN, f"{n:,} files are of another format than their extension says", {"files": n}, examples(ctx, audits.mismatched(ctx.df)), "Rename or convert them; some decoders are chosen by extension.", md_table(["mismatch", "files"], kinds))]


@check("int.mode_mix", "Several colour modes", "more than one: WARN", "integrity")
def mode_mix(ctx):
    modes = rows(relational.counts(ctx.rd.where("mode IS NOT NULL"), "mode"), F.desc("n"), "mode")
    if len(modes) <= 1:
        return [(PASS, f"One colour mode{': ' + modes[0][0] if modes else ''}")]
    odd = [r.label for r in rows(audits.dominant_values(ctx.rd, "mode").where("odd"), "label")]
    table = rows(relational.crosstab(ctx.rd, "label", "mode", [r[0] for r in modes]), "label")
    fix = "Convert everything to one mode, mostly RGB." + (f" The mode depends on the class ({', '.join(odd)}), so it may be a shortcut." if odd else "")
    return [(WARN, f"{len(modes)} colour modes: " + ", ".join(f"{m} ({n:,})" for m, n in modes), {"modes": {m: n for m, n in modes}, "class_dependent": bool(odd)}, examples(ctx, ctx.rd.where(F.col("mode") != modes[0][0]), F.col("mode")), fix, md_table(["class", *(r[0] for r in modes), "total"], table))]


@check("int.exif_rotation", "Pictures with a rotation flag", "any orientation but 1: WARN", "integrity")
def exif_rotation(ctx):
    bad = ctx.rd.where("exif_orientation IS NOT NULL AND exif_orientation <> 1")
    n = bad.count()
    if not n:
        return [(PASS, "No rotation flags")]
    return [(WARN, f"{n:,} files carry a rotation flag", {"files": n}, examples(ctx, bad, F.col("exif_orientation")), "Viewers turn these pictures, training code mostly doesn't. Apply the flag once and save again.")]


@check("int.blank", "Pictures of one colour", "contrast or entropy below their limit: WARN", "integrity")
def blank(ctx):
    bad = ctx.rd.where(ctx.blank)
    n = bad.count()
    if not n:
        return [(PASS, "No picture is blank")]
    return [(WARN, f"{n:,} pictures are nearly constant", {"files": n, "by_class": {r.label: r.n for r in relational.counts(bad, "label").collect()}}, examples(ctx, bad), "They carry no signal; look at the capture or export step and drop them.", "", ctx.grid("int_blank", bad))]


@check("int.tiny", "Very small pictures", "shorter side below 32 or a quarter of the target size: WARN", "integrity")
def tiny(ctx):
    limit = max(ctx.t["tiny_min_side"], 0.25 * (ctx.options.target_size or 0))
    bad = audits.below_size(ctx.df, limit)
    n = bad.count()
    if not n:
        return [(PASS, f"No shorter side is below {limit:g} pixels")]
    return [(WARN, f"{n:,} pictures have a side below {limit:g} pixels", {"files": n, "min_side_px": limit}, examples(ctx, bad, F.concat_ws("x", "width", "height")), "Enlarging them blurs them, which a model may take for a class. Collect larger ones.")]


@check("int.non_image", "Stray files", "any: INFO", "integrity")
def non_image(ctx):
    reasons = rows(relational.counts(ctx.stray, "reason"), F.desc("n"), "reason")
    if not reasons:
        return [(PASS, "No stray files")]
    n = sum(r.n for r in reasons)
    return [(INFO, f"{n:,} files were left out", {"files": n}, examples(ctx, ctx.stray, F.col("reason")), "Remove them, or see that your loader leaves them out too.", md_table(["reason", "files"], reasons))]


@check("int.empty_class", "Classes with few files or none", "under two classes or an empty one: BLOCKER; under 10 files: WARN", "integrity")
def empty_class(ctx):
    n = {r.label: r.n for r in rows(ctx.class_counts.where("label IS NOT NULL"), "label")}
    empty = [c for c, k in n.items() if not k]
    small = {c: k for c, k in n.items() if 0 < k < ctx.t["empty_class_warn"]}
    filled, out = len(n) - len(empty), []
    if filled < 2:
        out.append((BLOCKER, f"{filled} class with files", {"classes": filled}, [], "A classifier needs two classes; pictures belong in one folder per class."))
    if empty:
        out.append((BLOCKER, f"{len(empty)} classes have no file", {"empty": empty}, empty[: ctx.max_examples], "Remove the empty folders or fill them; frameworks give them a class number all the same."))
    if small:
        out.append((WARN, f"{len(small)} classes have under {ctx.t['empty_class_warn']:g} files", {"small": small}, [f"{c}  ({k})" for c, k in small.items()][: ctx.max_examples], "Collect more or merge them; figures on so few files mean little."))
    return out or [(PASS, f"All {len(n)} classes have files")]


# Leakage


@check("leak.exact_dup", "Byte-identical files", "across splits: BLOCKER; within: WARN", "leakage")
def exact_dup(ctx):
    found = {r.scope: r for r in audits.duplicate_summary(ctx.df).collect()}
    if not found:
        return [(PASS, "No byte-identical files")]
    groups = ctx.duplicates.exact.join(ctx.df.select(F.col(ctx.key).alias("id"), "relpath", "split"), "id").groupBy("first").agg(F.slice(F.sort_array(F.collect_set("relpath")), 1, 4).alias("paths"), F.count_distinct("split").alias("s"))
    lines = lambda cond: [" = ".join(r.paths) for r in rows(groups.where(cond), "first", most=ctx.max_examples)]
    out = []
    if c := found.get("cross"):
        out.append((BLOCKER, f"{c.n_groups:,} sets of identical files lie in several splits ({c.n_files:,} files)", {"groups": c.n_groups, "files": c.n_files}, lines("s > 1"), "Test scores are inflated. Keep one copy of each, or use the suggested splits."))
    if w := found.get("within"):
        out.append((WARN, f"{w.n_groups:,} sets of identical files lie within a split ({w.redundant:,} to spare)", {"groups": w.n_groups, "redundant": w.redundant}, lines("s <= 1"), "Copies weigh more in training. Keep one of each."))
    return out


def _pairs(ctx, links: DataFrame, note: str = "split") -> list[str]:
    return [f"{r.a_relpath} [{r['a_' + note]}]  <->  {r.b_relpath} [{r['b_' + note]}]  (distance {r.dist})" for r in rows(links, "a_relpath", "b_relpath", most=ctx.max_examples)]


@check("leak.near_dup", "Near copies across splits", "over 0.5 % of the test files: BLOCKER; fewer: WARN; without splits: INFO", "leakage")
def near_dup(ctx):
    links = ctx.duplicates.with_columns("relpath", "split")
    limit = int(ctx.t["near_dup_hamming"])
    if not ctx.has_splits:
        near = links.where("dist > 0")
        n = near.count()
        if not n:
            return [(PASS, f"No near copies (within {limit} bits)")]
        r = ctx.duplicates.components.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("component").alias("clusters")).first()
        return [(INFO, f"{n:,} links between near copies, in {r.clusters:,} clusters", {"pairs": n, "clusters": r.clusters, "images": r.files}, _pairs(ctx, near), "Keep each cluster in one split when you split; the suggested splits do.", "", ctx.pair_grid("leak_near_dup", near))]
    cross = links.where("a_split <> b_split")
    held = ctx.held
    leaked = ctx.duplicates.touching(F.col("split") == held, F.col("split") == "train").count()
    n = cross.count()
    if not n and not leaked:
        return [(PASS, f"No near copies across splits (within {limit} bits)")]
    whole = ctx.rd.where(F.col("split") == held).count()
    share = percent(leaked, whole)
    severity = BLOCKER if share > ctx.t["near_dup_pct_test_block"] else WARN
    return [(severity, f"{leaked:,} {held} files ({share} %) have a copy or near copy in train; {n:,} links cross splits", {"pairs": n, f"{held}_leaked": leaked, f"pct_{held}": share}, _pairs(ctx, cross), "Split again with each cluster in one split; the suggested splits do.", "", ctx.pair_grid("leak_near_dup", cross))]


@check("leak.label_conflict", "One picture under several labels", "any: BLOCKER", "leakage")
def label_conflict(ctx):
    bad = ctx.duplicates.with_columns("relpath", "label").where("NOT a_label <=> b_label")
    n = bad.count()
    if not n:
        return [(PASS, "Copies agree on their label")]
    files = ctx.duplicates.conflicting("label").count()
    return [(BLOCKER, f"{n:,} links join different labels ({files:,} files)", {"pairs": n, "images": files}, _pairs(ctx, bad, "label"), "A picture can't be of both classes. Settle the label of each pair and drop the other copy.", "", ctx.pair_grid("leak_label_conflict", bad))]


@check("leak.group", "Source groups in several splits", "declared groups: BLOCKER; inferred: WARN", "leakage")
def group(ctx):
    if not ctx.has_splits:
        return [skip("there are no splits")]
    declared = ctx.groups_declared and not ctx.df.where("`group` IS NOT NULL").isEmpty()
    df, pattern = ctx.df, ctx.options.group_regex
    if not declared:
        pattern = splitting.infer_groups(df, "path", "label")
        if pattern is None:
            return [skip("no groups are declared, and file names show none")]
        df = df.withColumn("group", splitting.group_from_name(F.col("path"), pattern))
    source = "declared" if declared else "inferred"
    n = df.where("`group` IS NOT NULL AND split IS NOT NULL").select(F.count_distinct("group")).first()[0]
    shared = audits.shared_groups(df)
    k = shared.count()
    if not k:
        return [(PASS, f"None of {n:,} {source} groups is in several splits")]
    lines = [f"{r.group}: {r.n_splits} splits, {r.n} files" for r in rows(shared, "group", most=ctx.max_examples)]
    fix = "Files of one source belong in one split; split again by group." if declared else f"File names suggest groups by {pattern}; if that is right, pass it as the group pattern and split by group."
    return [(BLOCKER if declared else WARN, f"{k:,} of {n:,} {source} groups are in several splits", {"groups_shared": k, "groups": n, "source": source, "pattern": pattern}, lines, fix)]


@check("leak.no_test_split", "No held-out split", "no splits or no test split: INFO", "leakage")
def no_test_split(ctx):
    if not ctx.has_splits:
        return [(INFO, "There are no splits yet", {}, [], "The suggested splits keep groups and copies together and classes in proportion.")]
    if "test" not in ctx.splits:
        return [(INFO, f"No test split, only {', '.join(ctx.splits)}", {}, [], "Keep a last test set that nothing is tuned on; the suggested splits have one.")]
    return [(PASS, f"Splits: {', '.join(ctx.splits)}")]


@check("leak.split_stats", "Splits of different distributions", "a model tells them apart with an AUC over 0.60: WARN; over 0.75: BLOCKER", "leakage")
def split_stats(ctx):
    if not ctx.has_splits or "train" not in ctx.splits:
        return [skip("there is no train split beside another")]
    c = statistics.chi2_independence(ctx.rd, "label", "split").first()
    p = statistics.chi2_survival(c.chi2, c.dof) if c.dof else 1.0
    least, table, worst = int(ctx.t["adv_val_min_images"]), [], None
    n = {r.split: r.n for r in relational.counts(ctx.rd, "split").collect()}
    features = [f for f in DRIFT_FEATURES if f in ctx.rd.columns]
    held = [s for s in ctx.splits if s != "train"]

    def compare(split: str):
        if min(n.get(split, 0), n.get("train", 0)) < least:
            return None
        two = ctx.rd.where(F.col("split").isin("train", split))
        js = statistics.js_distance(two, "label", "split", "train", split).first().js
        r = probes.numeric_probe(two, ctx.key, "split", {f: F.col(f) for f in features}, ctx.options.seed, int(ctx.t["max_probe_per_class"]))
        return js, r, rows(statistics.single_feature_auc(two, "split", features), F.desc("auc"), "feature", most=3)

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(compare, held))
    for split, x in zip(held, found, strict=True):
        if x is None:
            table.append([f"train and {split}", "-", "-", f"under {least} files"])
            continue
        js, r, top = x
        auc = r.auc if r else float("nan")
        table.append([f"train and {split}", js, auc, ", ".join(f"{t.feature} ({t.auc:.2f})" for t in top)])
        if r and (worst is None or auc > worst[1]):
            worst = split, auc, top
    details = md_table(["splits", "label JS distance", "AUC", "most different features"], table) + f"\n\nLabels independent of splits: p = {p:.3g}"
    if worst is None:
        return [(*skip(f"a split has under {least} files"), [], "", details)]
    split, auc, top = worst
    metric = {"adversarial_auc": round(auc, 3), "label_chi2_p": p}
    severity = BLOCKER if auc > ctx.t["adv_val_auc_block"] else WARN if auc > ctx.t["adv_val_auc_warn"] else PASS
    if severity is PASS:
        return [(PASS, f"Splits look alike (AUC {max(auc, 0.5):.2f} at most)", metric, [], "", details)]
    return [(severity, f"A model tells {split} from train (AUC {auc:.2f}), by {', '.join(x.feature for x in top)}", metric, [], "Scores won't show how the model does under training conditions. Split again within sources, or report a test out of distribution.", details)]


# Labels


@check("lab.distribution", "Class counts", "largest over smallest above 10: WARN; else INFO", "labels")
def distribution(ctx):
    i = statistics.imbalance(ctx.df, "label").first()
    n = {r.label: r.n for r in rows(relational.counts(ctx.df, "label"), F.desc("n"), "label")}
    details = md_table(["class", *ctx.splits, "total"], rows(relational.crosstab(ctx.df, "label", "split", ctx.splits), "label")) if ctx.splits else md_table(["class", "files"], n.items())
    metric = {"classes": i.classes, "imbalance_ratio": round(i.ratio or 1.0, 2), "counts": n}
    if i.ratio and i.ratio > ctx.t["imbalance_warn"]:
        return [(WARN, f"{i.largest} has {i.ratio:.1f} times the files of {i.smallest}", metric, [], "Report macro F1 or balanced accuracy; weigh classes or sample them evenly.", details)]
    return [(INFO, f"{i.classes} classes, the largest {i.ratio or 1:.1f} times the smallest", metric, [], "", details)]


@check("lab.split_coverage", "Files per class to evaluate on", "a held-out class under 30 files: WARN", "labels")
def split_coverage(ctx):
    if not ctx.held_out:
        return [skip("there is no held-out split")]
    need = int(ctx.t["min_test_per_class"])
    thin = rows(audits.split_coverage(ctx.df, ctx.held_out, need), "split", "label")
    if not thin:
        return [(PASS, f"Every class has {need} files or more in {', '.join(ctx.held_out)}")]
    table = [[r.split, r.label, r.n, f"±{r.ci_pp:.0f} points" if r.n else "none to evaluate"] for r in thin]
    return [(WARN, f"{len(thin)} classes of held-out splits have under {need} files", {"thin": [{"split": r.split, "class": r.label, "n": r.n} for r in thin]}, [], "Scores per class on so few files are mostly noise. Move files there, or report pooled scores.", md_table(["split", "class", "files", "95 % interval of a recall of 0.8"], table))]


@check("lab.stratification", "Class shares per split", "more than 5 points apart: WARN", "labels")
def stratification(ctx):
    if not ctx.has_splits:
        return [skip("there are no splits")]
    s = rows(audits.stratification(ctx.df, ctx.splits), F.desc("diff"), "label", "split")
    worst = s[0]
    by: dict = {}
    for r in s:
        by.setdefault(r.label, {})[r.split] = f"{r.share:.1f} %"
    details = md_table(["class", *ctx.splits], [[k, *(v.get(x, "-") for x in ctx.splits)] for k, v in sorted(by.items())])
    if worst["diff"] > ctx.t["stratification_pp_warn"]:
        return [(WARN, f"The share of {worst.label} in {worst.split} is {worst['diff']:.1f} points off that in {ctx.splits[0]}", {"max_diff_pp": round(worst["diff"], 2)}, [], "Split so that every split has the same shares.", details)]
    return [(PASS, f"Class shares agree across splits (within {worst['diff']:.1f} points)", {}, [], "", details)]


# Quality


@check("qual.resolution", "Sizes and aspect ratios", "over 10 % far from the median aspect: WARN; else INFO", "quality")
def resolution(ctx):
    r = audits.resolution(ctx.df).first()
    table = [[x.label, f"{x.median_width:.0f}x{x.median_height:.0f}", f"{x.min_width}x{x.min_height}", f"{x.max_width}x{x.max_height}", x.median_aspect] for x in rows(audits.sizes_by_label(ctx.df), "label")]
    details = md_table(["class", "median", "least", "most", "median aspect"], table)
    metric = {"distinct_sizes": r.n_sizes, "median_aspect": round(r.median_aspect, 3), "pct_distorted": r.pct_distorted}
    if r.pct_distorted > 100 * ctx.t["aspect_distort_frac"]:
        return [(WARN, f"{r.pct_distorted} % of the pictures are over 25 % off the median aspect", metric, [], "Resizing to a fixed size stretches them; pad them, or crop at random.", details)]
    top = rows(relational.counts(ctx.rd.where("width IS NOT NULL"), "width", "height"), F.desc("n"), "width", "height", most=3)
    return [(INFO, f"{r.n_sizes:,} sizes, mostly " + ", ".join(f"{x.width}x{x.height} ({x.n:,})" for x in top), metric, [], "", details)]


@check("qual.resize_risk", "Detail lost at the training size", "over 5 % lose half of their edges: WARN", "quality")
def resize_risk(ctx):
    size = ctx.options.target_size
    if not size:
        return [skip("no target size is given")]
    limit = ctx.t["resize_edge_loss"]
    loss = audits.detail_loss(ctx.df)
    r = loss.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("loss") > limit).alias("bad")).first()
    if not r.n:
        return [skip("the pictures have too few edges")]
    by = rows(loss.groupBy("label").agg(F.round(100 * F.avg((F.col("loss") > limit).cast("double")), 1)), "label")
    share, details = percent(r.bad, r.n), md_table(["class", "% losing half of their edges"], by)
    metric = {"target_size": size, "pct_flagged": share, "median_edge_loss": round(statistics.medians(loss, [], ["loss"]).first().loss, 3)}
    if r.bad / r.n > ctx.t["resize_flag_frac"]:
        bad = loss.where(F.col("loss") > limit)
        return [(WARN, f"{share} % of the pictures lose over half of their edges at {size} pixels", metric, ordered_examples(ctx, bad, F.desc("loss"), F.round("loss", 2)), "Thin structures vanish at this size. Train at a larger one, or on tiles.", details, ctx.grid("qual_resize_risk", bad))]
    return [(PASS, f"Detail survives at {size} pixels ({share} % flagged)", metric, [], "", details)]


@check("qual.blur", "Blurry pictures", "any: INFO; unevenly spread over classes: WARN", "quality")
def blur(ctx):
    z = ctx.t["blur_z"]
    rate = rows(audits.blur_rates(ctx.df, z), "label")
    details = md_table(["class", "files", "blurry", "%"], rate)
    n = sum(r.n_blurry for r in rate)
    if not n:
        return [(PASS, "No picture is unusually blurry", {}, [], "", details)]
    high, low = max(rate, key=lambda r: r.pct_blurry), min(rate, key=lambda r: r.pct_blurry)
    uneven = high.pct_blurry - low.pct_blurry > 5 and 2 * low.pct_blurry < high.pct_blurry
    bad = audits.blur_scores(ctx.df).where(F.col("z") < z)
    title = f"{n:,} pictures are unusually blurry" + (f", mostly of {high.label} ({high.pct_blurry:.1f} %)" if uneven else "")
    return [(WARN if uneven else INFO, title, {"files": n, "pct": percent(n, ctx.n_readable), "rate_by_class": {r.label: r.pct_blurry for r in rate}}, ordered_examples(ctx, bad, F.col("sharpness"), F.round("sharpness", 1)), "Look at them and drop what can't be used." + (" Blur that depends on the class is a shortcut." if uneven else ""), details, ctx.grid("qual_blur", bad))]


@check("qual.exposure", "Over- and underexposed pictures", "over 20 % of the pixels clipped: INFO", "quality")
def exposure(ctx):
    limit = ctx.t["exposure_clipped_frac"]
    bad = audits.over(ctx.df, "clipped_frac", limit)
    n = bad.count()
    if not n:
        return [(PASS, "No picture is badly exposed")]
    by = {r.label: r.n for r in relational.counts(bad, "label").collect()}
    return [(INFO, f"{n:,} pictures have over {100 * limit:.0f} % of their pixels clipped", {"files": n, "by_class": by}, ordered_examples(ctx, bad, F.desc("clipped_frac"), F.round(100 * F.col("clipped_frac"))), "Look at their exposure; varying the brightness in training can help.", "", ctx.grid("qual_exposure", bad))]


@check("qual.normalization", "Channel means and deviations", "INFO", "quality")
def normalization(ctx):
    train = ctx.has_splits and "train" in ctx.splits
    df = ctx.df.where("split = 'train'") if train else ctx.df
    r = audits.pooled(df, {c: (f"mean_{c}", f"std_{c}") for c in "rgb"}).first()
    if r.mean_r is None:
        return [skip("nothing is readable there")]
    mean, std = [r[f"mean_{c}"] for c in "rgb"], [r[f"std_{c}"] for c in "rgb"]
    show = lambda v: "[" + ", ".join(f"{x:.4f}" for x in v) + "]"
    source = "the train split" if train else "all files"
    return [(INFO, f"Mean {show(mean)}, deviation {show(std)}", {"mean": mean, "std": std, "source": source}, [], "", f"```python\n# RGB from 0 to 1, over {source}\nmean = {show(mean)}\nstd = {show(std)}\n```")]


@check("qual.slices", "Domains", "a domain under 5 % of the files: WARN; else INFO", "quality")
def slices(ctx):
    if ctx.rd.where("domain IS NOT NULL").isEmpty():
        return [skip("there are no domains")]
    s = rows(audits.slices(ctx.df), F.desc("n"), "domain")
    cross = rows(relational.crosstab(ctx.rd.withColumn("domain", F.coalesce("domain", F.lit("(none)"))), "domain", "label", ctx.labels), "domain")
    details = md_table(["domain", "files", "share", "median brightness", "median sharpness"], s) + "\n\n" + md_table(["domain", *ctx.labels, "total"], cross)
    metric = {"domains": {r.domain: round(r.share, 4) for r in s}}
    small = [r.domain for r in s if r.share < ctx.t["slice_min_frac"]]
    if small:
        return [(WARN, f"{len(small)} domains have under {100 * ctx.t['slice_min_frac']:.0f} % of the files: {', '.join(small)}", metric, [], "Report scores per domain; overall ones hide how these fare.", details)]
    return [(INFO, f"{len(s)} domains", metric, [], "", details)]


# Shortcuts


def _verdict(ctx, r, what: str, warn: str, block: str | None, fix: str, top=()) -> tuple:
    if r is None:
        return skip("too few files per class for a probe")
    metric = {"auc": round(r.auc, 3), "balanced_accuracy": round(r.balanced_accuracy, 3), "n": r.n}
    details = ""
    if top:
        metric["top_features"] = {x.feature: round(x.auc, 3) for x in top}
        details = md_table(["feature", "AUC on its own"], [[x.feature, x.auc] for x in top])
    severity = BLOCKER if block and r.auc > ctx.t[block] else WARN if r.auc > ctx.t[warn] else PASS
    if severity is PASS:
        return PASS, f"{what} doesn't tell the label (AUC {max(r.auc, 0.5):.2f})", metric, [], "", details
    return severity, f"{what} alone tells the label (AUC {r.auc:.2f})" + (f", above all {top[0].feature}" if top else ""), metric, [], fix, details


@check("short.metadata", "Labels that metadata tells", "AUC over 0.70: WARN; over 0.85: BLOCKER", "shortcuts")
def metadata(ctx):
    df = ctx.rd
    features = {"width": F.col("width"), "height": F.col("height"), "aspect": audits.aspect(), "jpeg quality": F.col("jpeg_quality")}
    for name, c in (("format", "format"), ("color mode", "mode"), ("camera", "camera_model")):
        df, features[name] = probes.codes(F.col(c), df)
    r = probes.numeric_probe(df, ctx.key, "label", features, ctx.options.seed, int(ctx.t["max_probe_per_class"]))
    wide = df.select("label", *[c.cast("double").alias(n) for n, c in features.items()], F.col("bytes").cast("double").alias("file size"))
    singles = rows(statistics.single_feature_auc(wide, "label", [*features, "file size"]), F.desc("auc"), "feature")
    top = [x for x in singles if x.feature != "file size"][:5]
    out = _verdict(ctx, r, "File metadata", "shortcut_auc_warn", "shortcut_auc_block", "Classes were stored differently. Encode all files alike, in size, format and quality.", top)
    size = next((x.auc for x in singles if x.feature == "file size"), 0.5)
    if len(out) > 3 and size > ctx.t["shortcut_auc_warn"]:  # told, but not scored: size follows the detail of a picture
        out = (*out[:2], out[2] | {"file_size_auc": round(size, 3)}, *out[3:5], f"{out[5]}\n\nThe file size tells the classes apart too (AUC {size:.2f}); it also grows with detail, so it isn't scored.".strip())
    return [out]


@check("short.filename", "Labels that file names tell", "AUC over 0.70: WARN; over 0.85: BLOCKER", "shortcuts")
def filename(ctx):
    tokens = [r.token for r in rows(probes.naming_tokens(ctx.rd, "path", "label"), "token")]
    r = probes.filename_probe(ctx.rd, ctx.key, "label", "path", tokens, ctx.options.seed, int(ctx.t["max_probe_per_class"]))
    out = _verdict(ctx, r, "The file name without class names", "shortcut_auc_warn", "shortcut_auc_block", "Names carry sources, numbers or dates that differ by class; look for groups in several splits and for biased sources.")
    if len(out) > 3 and tokens:
        out = (*out[:2], out[2] | {"ignored_tokens": tokens}, *out[3:5], "Left out: " + ", ".join(tokens))
    return [out]


@check("short.thumbnail", "Labels that overall colour tells", "AUC over 0.80: WARN", "shortcuts")
def thumbnail(ctx):
    r = probes.vector_probe(ctx.rd, ctx.key, "label", "thumb", ctx.options.seed, int(ctx.t["max_probe_per_class"]))
    return [_verdict(ctx, r, "A thumbnail of 8 x 8 pixels", "thumbnail_auc_warn", None, "Colour or brightness differs by class. If colour doesn't define the classes, capture conditions do; vary colours in training.")]


@check("short.border", "Labels that the background tells", "AUC over 0.75: WARN; over 0.90: BLOCKER", "shortcuts")
def border(ctx):
    r = probes.vector_probe(ctx.rd, ctx.key, "label", "border", ctx.options.seed, int(ctx.t["max_probe_per_class"]))
    return [_verdict(ctx, r, "The border of the picture", "border_auc_warn", "border_auc_block", "Backgrounds differ by class. Use like backgrounds, crop to the object, and look for frames or padding.")]


@check("short.stat_by_class", "Features most tied to the label", "INFO", "shortcuts")
def stat_by_class(ctx):
    if len(ctx.labels) < 2:
        return [skip("there is one class")]
    features = [f for f in CLASS_FEATURES if f in ctx.rd.columns]
    top = rows(statistics.kruskal(ctx.rd, "label", features), F.desc("effect"), "feature", most=5)
    if not top:
        return [skip("no feature varies")]
    medians = statistics.medians(ctx.rd.where("label IS NOT NULL"), ["label"], [r.feature for r in top]).orderBy("label").collect()
    ends = lambda f: [pick((m for m in medians if m[f] is not None), key=lambda m: m[f]).label for pick in (max, min)]
    table = [[r.feature, r.effect, f"{statistics.chi2_survival(r.h, r.dof):.2g}", *ends(r.feature)] for r in top]
    return [(INFO, f"{top[0].feature} depends most on the label (effect {top[0].effect:.2f}, highest in {table[0][3]})", {"top": {r.feature: round(r.effect, 4) for r in top}}, [], "", md_table(["feature", "effect", "p", "highest in", "lowest in"], table))]


# Baselines


@check("base.majority", "Always the largest class", "INFO", "baselines")
def majority(ctx):
    r = audits.majority(ctx.df, "train" if "train" in ctx.splits else None, ctx.held).first()
    where = f"on {ctx.held}" if ctx.held else "on all files"
    k = max(1, r.classes)
    return [(INFO, f"Always saying {r.label} is right in {r.accuracy:.1%} {where} (balanced {1 / k:.1%})", {"majority_class": r.label, "accuracy": round(r.accuracy, 4), "balanced_accuracy": round(1 / k, 4)}, [], "A model must clearly beat this.")]


@check("base.metric_advice", "The metric to report", "INFO", "baselines")
def metric_advice(ctx):
    i = statistics.imbalance(ctx.df, "label").first()
    uneven = i.ratio >= 3
    metric = ("macro-F1" + (" and PR-AUC" if i.classes == 2 else "")) if uneven else "accuracy (plus macro-F1)"
    return [(INFO, f"Report {metric}: the largest class has {i.ratio:.1f} times the files of the smallest", {"recommended": metric, "imbalance_ratio": round(i.ratio, 2)})]


def to_findings(c, results: list[tuple]) -> list[Finding]:
    """From (severity, title, metric, evidence, fix, details, assets), the later ones optional."""
    out = []
    for severity, title, *rest in results:
        metric, evidence, fix, details, assets = (list(rest) + [None] * 5)[:5]
        out.append(Finding(c.id, c.section, severity, title, metric or {}, evidence or [], assets or [], fix or "", details or ""))
    return out
