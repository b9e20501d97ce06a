from lociflow.sources import tables as T
from lociflow.sources import vcf


def put(path, text):
    path.write_text(text)
    return str(path)


VCF = "##fileformat=VCFv4.2\n##contig=<ID=chr1>\n##INFO=<ID=DP,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"


def test_vcf(spark, tmp_path):
    body = "chr1\t10\trs1\tA\tC\t50\tPASS\tDP=3;FLAG\tGT:DP\t0/1:3\t1/1:4\nchr1\t20\t.\tA\tC,G\t.\tlow\tAF=0.1,0.2\tGT\t1|2\t./.\nchr1\t30\nchr2\t40\t.\tA\tT\t9\tPASS\t.\tGT\t0/0\t0/1\n"
    p = put(tmp_path / "a.vcf", VCF + body)
    rows = vcf.read(spark, p)
    got = sorted((r.pos, r.sample_id, r.alt, r.quality) for r in rows.collect())
    assert got == [(10, "A", "C", 50.0), (10, "B", "C", 50.0), (10, "B", "C", 50.0), (20, "A", "C", 0.0), (20, "A", "G", 0.0), (40, "B", "T", 9.0)]
    assert {(r.alt, r.info["AF"]) for r in rows.where("pos = 20").collect()} == {("C", "0.1"), ("G", "0.2")}
    assert rows.where("pos = 10").first().info == {"DP": "3", "FLAG": "true"}
    assert vcf.read(spark, p, min_quality=10, pass_only=True).count() == 3
    head = vcf.read_header(spark, p)
    assert head["samples"] == ["A", "B"] and head["contigs"] == ["chr1"] and head["info"] == ["DP"]
    lines = vcf.to_lines(rows.where("pos = 10"), ["A", "B"])
    assert [r.value for r in lines.collect()] == ["chr1\t10\trs1\tA\tC\t50.0\tPASS\tDP=3;FLAG=true\tGT\t0/1\t1/1"]


def test_vcf_without_samples(spark, tmp_path):
    p = put(tmp_path / "b.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t5\t.\tA\tC,T\t1\tPASS\tDP=1\n")
    assert {(r.sample_id, r.alt) for r in vcf.read(spark, p).collect()} == {("UNKNOWN", "C"), ("UNKNOWN", "T")}


def test_gmt_round_trip(spark, tmp_path):
    p = put(tmp_path / "a.gmt", "# c\nS1\td\tG1\tG2\tNA\tG1\t\nS2\tonly\nR%X%N\tq\tG3\n")
    m = T.read_gmt(spark, p, name_from_id=True)
    assert {(r.pathway_id, r.name, r.gene) for r in m.collect()} == {("S1", "S1", "G1"), ("S1", "S1", "G2"), ("R%X%N", "N", "G3")}
    T.write_gmt(m, str(tmp_path / "out"))
    back = T.read_gmt(spark, str(tmp_path / "out"))
    assert {(r.pathway_id, r.gene) for r in back.collect()} == {("S1", "G1"), ("S1", "G2"), ("R%X%N", "G3")}


def test_ontology(spark, tmp_path):
    obo = put(tmp_path / "a.obo", 'format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: p\ndef: "x y" [r]\nis_a: GO:2 ! two\n\n[Term]\nid: GO:2\nname: two\nnamespace: p\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    gaf = put(tmp_path / "a.gaf", "!c\nDB\tid\tG1\t\tGO:1\nDB\tid\tG2\tNOT|x\tGO:1\nshort\n")
    terms = T.read_obo(spark, obo)
    assert [(r.term_id, r.definition, r.parents) for r in terms.collect()] == [("GO:1", "x y", ["GO:2"])]
    assert [(r.pathway_id, r.gene) for r in T.go_sets(terms, T.read_gaf(spark, gaf)).collect()] == [("GO:1", "G1")]


def test_tables(spark, tmp_path):
    c = T.read_constraint(spark, put(tmp_path / "c.tsv", "Gene_Symbol\tpLI\toe_lof_upper\nG1\t0.9\tNA\nG1\tNA\t0.3\nG2\tx\t1\n"))
    assert {(r.gene, r.pli, r.loeuf, r.mis_z) for r in c.collect()} == {("G1", 0.9, 0.3, None), ("G2", None, 1.0, None)}
    d = T.read_disease_genes(spark, put(tmp_path / "d.csv", 'gene-symbol,gene-name,gene-score,syndromic\nG1,"a, b",3S,yes\n'))
    assert [(r.gene_symbol, r.gene_name, r.gene_score) for r in d.collect()] == [("G1", "a, b", "3S")]
    p = T.read_ppi(spark, put(tmp_path / "p.txt", "protein1 protein2 combined_score\n9606.A 9606.B 900\n9606.A 9606.C 100\n"))
    assert [tuple(r) for r in p.collect()] == [("A", "B", 900.0)]
    g = T.read_gene_info(spark, put(tmp_path / "g.tsv", "#tax_id\tGeneID\tSymbol\tSynonyms\tdbXrefs\tchromosome\tdescription\ttype_of_gene\n9606\t1\tS\ta|b\tHGNC:1|Ensembl:ENSG1\t7\tn\tprotein\n10090\t2\tM\t-\t-\t1\tm\tx\n"))
    assert [(r.symbol, r.ensembl_id, r.aliases) for r in g.collect()] == [("S", "ENSG1", ["a", "b"])]
    h = T.read_gene_table(spark, put(tmp_path / "h.tsv", "symbol\tst\talias_symbol\tprev\nS\t5\ta | b\tb\n\t1\t\t\n"), {"symbol": "symbol", "start_bp": "st"}, alias_columns=("alias_symbol", "prev"))
    assert [(r.symbol, r.start_bp, r.aliases) for r in h.collect()] == [("S", 5, ["a", "b"])]
    w = T.read_wide(spark, put(tmp_path / "w.csv", "gene,T1,T2\nG,3,x\n"), "gene", "cell_type")
    assert {(r.cell_type, r.value) for r in w.collect()} == {("T1", 2.0), ("T2", 0.0)}
    drugs, targets = T.read_drugs(spark, put(tmp_path / "dr.csv", "drug_id,drug_name,targets,status,mechanism\nD1,n,G1; G2;,Approved,m\nD2,o,,odd,\n"))
    assert {(r.candidate_id, r.status) for r in drugs.collect()} == {("D1", "approved"), ("D2", "unknown")} and targets.count() == 2


def test_expression(spark, tmp_path):
    m, c, r = (put(tmp_path / n, t) for n, t in (("m.csv", "1,3,7\n2,NA,1\n"), ("c.csv", "column_num,age,structure_acronym\n1,8 pcw,V1\n2,2 yrs,V1\n"), ("r.csv", "row_num,gene_symbol\n1,G1\n2,G2\n")))
    got = {(x.gene, x.stage): x.value for x in T.read_expression(spark, m, c, r).collect()}
    assert got == {("G1", "8 pcw"): 2.0, ("G1", "2 yrs"): 3.0, ("G2", "8 pcw"): None, ("G2", "2 yrs"): 1.0}


def test_graph_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "gene"), ("b'", "gene")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b'", "x", 0.5)], "src string, dst string, edge_type string, weight double")
    T.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = T.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.first().weight == 0.5
    assert [r.value for r in T.cypher(nodes, edges).orderBy("step", "value").collect()][-1] == "MATCH (a {id: 'a'}), (b {id: 'b\\''}) CREATE (a)-[:x {weight: 0.5}]->(b);"


def test_long_vcf_header_keeps_its_samples(spark, tmp_path):
    p = tmp_path / "long.vcf"
    head = ["##fileformat=VCFv4.2", *(f"##contig=<ID=c{i},length=9>" for i in range(120_000)), '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all reads">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"]
    p.write_text("\n".join([*head, "c1\t5\t.\tA\tC\t9\tPASS\tDP=3\tGT\t0/1\t0/0"]) + "\n")
    h = vcf.read_header(spark, str(p))
    assert h["samples"] == ["S1", "S2"] and len(h["contigs"]) == 120_000 and h["definitions"]["INFO"] == [{"ID": "DP", "Number": "1", "Type": "Integer", "Description": "Depth, all reads"}]
    assert [r.sample_id for r in vcf.read(spark, str(p)).collect()] == ["S1"]


def test_site_scores_and_drug_files(spark, tmp_path):
    import json


    from lociflow.sources import tables as T

    (tmp_path / "cadd.tsv").write_text("## a comment\n#Chrom\tPos\tRef\tAlt\tRawScore\tPHRED\n1\t5\tA\tC\t0.1\t20.5\nchr1\t5\tA\tC\t0.1\t21\n2\tx\tA\tC\t0\t1\n")
    v = spark.createDataFrame([("chr1", 5, "A", "C"), ("chr1", 5, "A", "G")], "chrom string, pos bigint, ref string, alt string")
    got = T.with_site_score(v, T.read_site_scores(spark, str(tmp_path / "cadd.tsv"), "PHRED"), "cadd").collect()
    assert {(r.alt, r.cadd) for r in got} == {("C", 21.0), ("G", None)}
    drugs = spark.createDataFrame([("d1", "one", "approved", "m")], "candidate_id string, name string, status string, mechanism string")
    (tmp_path / "sets.csv").write_text("drug_id,pathway_id\nd1,p1\nd2,p1\nd2,p1\n,p3\n")
    e, every = T.read_drug_sets(spark, str(tmp_path / "sets.csv"), drugs)
    assert e.count() == 2 and {(r.candidate_id, r.status) for r in every.collect()} == {("d1", "approved"), ("d2", "unknown")}
    (tmp_path / "rel.csv").write_text("drug_id,asd_relevance_score\nd1,1.7\n")
    assert {(r.candidate_id, r.relevance) for r in T.read_relevance(spark, str(tmp_path / "rel.csv"), every).collect()} == {("d1", 1.0), ("d2", 0.0)}
    (tmp_path / "d.json").write_text(json.dumps({"drugs": [{"drug_id": "d1", "drug_name": "one", "status": "Approved", "mechanism": None, "targets": ["G1"]}, {"drug_id": "d2"}]}))
    j = T.read_drugs_json(spark, str(tmp_path / "d.json"))
    T.write_drugs_json(j, str(tmp_path / "out"))
    assert sorted(map(str, T.read_drugs_json(spark, str(tmp_path / "out")).collect())) == sorted(map(str, j.collect())) and j.count() == 2
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("a", "b", "y", 2.0), ("a", "c", "x", 1.0)], "src string, dst string, edge_type string, weight double")
    index = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node_id string, idx bigint")
    T.write_node_index(index, str(tmp_path / "idx"))
    assert [(r.row, r.columns, r.weights) for r in T.adjacency(edges, T.read_node_index(spark, str(tmp_path / "idx"))).collect()] == [(0, [1, 2], [3.0, 1.0])]
    assert T.edge_index(edges, index).count() == 3
