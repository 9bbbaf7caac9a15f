"""fragweave: Spark plans that reassemble files from shuffled, overlapping, damaged binary fragments."""
