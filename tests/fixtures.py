"""Five small tree sequences on four samples, as text."""

from grovewise.sources.text import tables_from_text

T1 = "0 1 4 0,1\n0 1 5 2,3\n0 1 6 4,5"
T3 = "2 10 4 2,3\n0 10 5 1\n0 2 5 3\n2 10 5 4\n0 7 6 0,5\n7 10 7 0,5\n0 2 8 2,6"
S3 = "1 0\n4.5 0\n8.5 0"
EXAMPLES = {
    "paper_ex": (10, 9, T3, S3, "0 2 1\n1 0 1\n2 5 1"),
    "single_tree_ex": (1, 7, T1, ".125 0\n.25 0\n.5 0", "0 2 1 -1\n1 4 1 -1\n1 0 0 1\n2 0 1 -1\n2 1 1 -1\n2 2 1 -1\n2 3 1 -1"),
    "multi_tree_back_recurrent": (10, 9, T3, S3, "0 6 1 -1\n0 5 0 0\n0 3 1 1\n1 5 1 -1\n1 4 0 3\n2 4 1 -1"),
    "multi_derived_states": (10, 9, T3, S3, "0 6 1 -1\n0 5 0 0\n0 3 2 1\n1 5 3 -1\n1 4 0 3\n2 4 1 -1"),
    "single_tree_multi_derived_states": (1, 7, T1, ".5 0", "0 1 1 -1\n0 5 2 -1"),
}


def tables(spark, name):
    length, n, edges, sites, mutations = EXAMPLES[name]
    return tables_from_text(spark, length, "\n".join(f"{int(i < 4)} 0" for i in range(n)), edges, sites, mutations)
