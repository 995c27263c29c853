"""Home-location inference and text clustering for posts, as Spark DataFrame plans."""
