"""folioflow: Spark-native analytics over notebooks, pages, links, revisions and attachments."""
