from strophe.llm import license_scan


def test_a_version_is_told_only_where_it_fits(spark):
    notice = "This work is licensed under the GNU General Public License, version {}."
    docs = [(i, notice.format(v)) for i, v in enumerate("231")]
    found = license_scan.with_versions(license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.templates(spark)))
    got = {(r.doc_id, r.template_id): r.license for r in found.collect()}
    assert got == {
        (0, "gpl-2-notice"): "GPL-2.0", (0, "gpl-notice"): "GPL",
        (1, "gpl-2-notice"): "GPL", (1, "gpl-notice"): "GPL-3.0",
        (2, "gpl-2-notice"): "GPL", (2, "gpl-notice"): "GPL",
    }
