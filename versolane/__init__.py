"""versolane: preparing and running large document-translation jobs as Spark DataFrames."""
