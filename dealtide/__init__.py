"""Sales-funnel and services-staffing analytics as Spark DataFrame operators."""
