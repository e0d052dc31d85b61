"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache(texts: DataFrame, path: str, tag: str) -> None:
    """Adds texts (leaf, text) to a cache partitioned by tag; the tag must name all that the texts depend on, such as caps."""
    texts.withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("tag").parquet(path)


def nexus(matrix: DataFrame) -> str:
    """A NEXUS data block of (leaf, bits); the matrix has one row for each taxon."""
    rows = [(r["leaf"].replace(" ", "_"), r["bits"]) for r in matrix.orderBy("leaf").collect()]
    width = max((len(n) for n, _ in rows), default=0) + 2
    head = f"#NEXUS\nBEGIN DATA;\n  DIMENSIONS NTAX={len(rows)} NCHAR={len(rows[0][1]) if rows else 0};\n"
    return head + '  FORMAT DATATYPE=STANDARD SYMBOLS="01" MISSING=? GAP=-;\n  MATRIX\n' + "".join(f"    {n:<{width}}{b}\n" for n, b in rows) + "  ;\nEND;\n"


#: The sampler's packages and classes, and the moves on a tree with their weights.
PACKAGES = {
    "base": "beast.base.evolution", "run": "beast.base.inference", "alignment": "beast.base.evolution.alignment", "tree": "beast.base.evolution.tree",
    "sites": "beast.base.evolution.sitemodel", "substitution": "beast.base.evolution.substitutionmodel", "clock": "beast.base.evolution.branchratemodel",
    "likelihood": "beast.base.evolution.likelihood", "birth": "beast.base.evolution.speciation", "moves": "beast.base.evolution.operator",
    "walk": "beast.base.evolution.operator.kernel", "spread": "beast.base.inference.distribution", "value": "beast.base.inference.parameter", "join": "beast.base.inference.operator.kernel",
}
TREE_MOVES = (("walk", "BactrianScaleOperator", 3), ("walk", "BactrianNodeOperator", 30), ("walk", "BactrianSubtreeSlide", 15), ("moves", "Exchange", 15), ("moves", "WilsonBalding", 3))


def sampler_xml(matrix: DataFrame, chain: int = 1_000_000, name: str = "characters") -> str:
    """A complete XML model for a Bayesian tree sampler: binary characters with estimated frequencies and equal rates, a strict clock
    and a Yule prior, both rates with uniform priors up to 1000; it logs trees and figures. The matrix (leaf, bits) has one row for each taxon.
    """
    import xml.etree.ElementTree as ET

    def add(to, tag: str, spec: str | None = None, text: str | None = None, **more):
        package, _, kind = (spec or "").partition(":")
        out = ET.SubElement(to, tag, {k.rstrip("_"): str(v) for k, v in more.items()} | ({"spec": f"{PACKAGES[package]}.{kind}"} if spec else {}))
        out.text = text
        return out

    root = ET.Element("beast", version="2.7", namespace=":".join(dict.fromkeys(PACKAGES.values())))
    data = add(root, "data", "alignment:Alignment", id=name, dataType="binary")
    for r in matrix.orderBy("leaf").collect():
        add(data, "sequence", "alignment:Sequence", id=f"seq_{r['leaf']}", taxon=r["leaf"], totalcount=2, value=r["bits"])
    run = add(root, "run", "run:MCMC", id="mcmc", chainLength=chain)
    state = add(run, "state", "run:State", id="state", storeEvery=max(1, chain // 200))
    add(add(state, "tree", "tree:Tree", id="tree", name="stateNode"), "taxonset", "alignment:TaxonSet", id="taxa", alignment=f"@{name}")
    for rate in ("birthRate", "clockRate"):
        add(state, "parameter", "value:RealParameter", "1.0", id=rate, name="stateNode", lower="0.0")
    add(state, "parameter", "value:RealParameter", "0.5", id="frequencies", name="stateNode", dimension=2, lower="0.0", upper="1.0")
    start = add(run, "init", "tree:coalescent.RandomTree", id="start", estimate="false", initial="@tree", taxa=f"@{name}")
    population = add(start, "populationModel", "tree:coalescent.ConstantPopulation", id="population")
    add(population, "popSize", "value:RealParameter", "1.0", id="popSize")
    posterior = add(run, "distribution", "run:CompoundDistribution", id="posterior")
    prior = add(posterior, "distribution", "run:CompoundDistribution", id="prior")
    add(prior, "distribution", "birth:YuleModel", id="yule", tree="@tree", birthDiffRate="@birthRate")
    for rate in ("birthRate", "clockRate"):
        flat = add(prior, "distribution", "spread:Prior", id=f"{rate}Prior", x=f"@{rate}")
        add(flat, "distr", "spread:Uniform", id=f"{rate}Range", upper="1000.0")
    like = add(posterior, "distribution", "likelihood:TreeLikelihood", id="likelihood", data=f"@{name}", tree="@tree")
    site = add(like, "siteModel", "sites:SiteModel", id="sites")
    for parameter, value in (("mutationRate", "1.0"), ("shape", "1.0"), ("proportionInvariant", "0.0")):
        add(site, "parameter", "value:RealParameter", value, id=parameter, name=parameter, estimate="false")
    model = add(site, "substModel", "substitution:GeneralSubstitutionModel", id="model")
    add(model, "parameter", "value:RealParameter", "1.0 1.0", id="rates", name="rates", dimension=2, estimate="false")
    add(model, "frequencies", "substitution:Frequencies", id="estimated", frequencies="@frequencies")
    add(like, "branchRateModel", "clock:StrictClockModel", id="clock", clock_rate="@clockRate").attrib["clock.rate"] = "@clockRate"
    like[-1].attrib.pop("clock_rate")
    for package, kind, weight in TREE_MOVES:
        add(run, "operator", f"{package}:{kind}", id=f"tree{kind}", tree="@tree", weight=weight)
    for rate in ("birthRate", "clockRate"):
        add(run, "operator", "walk:BactrianScaleOperator", id=f"{rate}Scaler", parameter=f"@{rate}", weight=3)
    swap = add(run, "operator", "join:BactrianDeltaExchangeOperator", id="frequencyExchange", delta="0.01", weight="0.1")
    add(swap, "parameter", idref="frequencies")
    every = max(1, chain // 1000)
    figures = add(run, "logger", "run:Logger", id="figures", fileName=f"{name}.log", logEvery=every, model="@posterior")
    for x in ("posterior", "likelihood", "prior", "birthRate", "clockRate", "frequencies"):
        add(figures, "log", idref=x)
    add(add(run, "logger", "run:Logger", id="trees", fileName=f"{name}.trees", logEvery=every, mode="tree"), "log", idref="tree")
    return ET.tostring(root, encoding="unicode")


def json_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
