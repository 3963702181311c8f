"""intakespark: contact-record cleaning, classification and scoring as Spark DataFrame transformations."""
