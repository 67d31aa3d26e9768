"""syntarel: code analytics and corpus preparation as relational plans on Spark."""
